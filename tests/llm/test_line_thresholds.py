"""Documents from which lines of different lengths recur."""

from seqloom.llm import line_dedup as L


def test_long_lines_recur_in_two_documents_and_short_ones_in_ten(spark):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    middle = "a line of more than five words here"
    rows = [(k, f"{(chr(97 + k) * 9 + " ") * 6}\nAll rights reserved.\nPage {k}\n\n" + ("Not so often.\n" if k < 9 else "")) for k in range(12)]
    rows += [(20, long + "\n" + middle), (21, "\t" + long.replace(" ", "  ") + "\n" + middle), (22, " ".join(long.split()[:19])), (23, " ".join(long.split()[:19]))]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in L.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        if 0 < k < 12:
            assert got[k] == (text.replace("All rights reserved.\n", ""), 1)
        elif k == 21:
            assert got[k] == (middle, 1)
        else:
            assert got[k] == (text, 0)
