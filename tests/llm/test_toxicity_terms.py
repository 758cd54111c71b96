"""Terms of all lengths met with an edit."""

from seqloom.llm import toxicity as T


def test_short_rare_and_weak_terms_are_met_with_an_edit():
    counts = [("W:scum", 90, 0), ("W:moron", 90, 0), ("W:pathetic", 4, 0), ("W:loser", 60, 40), ("W:bad", 90, 0)]
    got = T.choose_lexicon(counts, 100, 2000)
    model = {**got, "neighbours": [], "bias": -3.0, "weights": [2.0, 0.4, 1.0, 1.0]}
    s = T.Scorer(model)
    assert s.meet("scum") == s.meet("moron") == (T.EXACT, 1.0) and s.meet("loser") == (T.WEAK, 1.0)
    (a, scum), (b, moron), (c, rare), (d, weak) = map(s.meet, ("scmu", "morn", "pathetc", "losser"))
    assert (a, b, c, d) == (T.FUZZY, T.FUZZY, T.FUZZY, T.WEAK)
    assert 0 < scum < moron == weak == T.NEAR and 0 < rare < moron
    assert s.meet("bat") == (0, 0.0) and s.score("bat") < s.score("you scmu") < s.score("you moron")


def test_one_clean_row_does_not_excuse_a_misspelling(spark):
    clean = [f"plain words of row {k} and no more" for k in range(40)] + ["they wrote morron here"] + ["the moran family"] * 5
    toxic = [f"you moron number {k}" for k in range(10)]
    docs = spark.createDataFrame([*enumerate(clean + toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(clean + toxic))], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    assert T.Scorer(model).meet("morron")[0] == T.FUZZY
    assert "moran" in model["neighbours"] and T.Scorer(model).meet("moran") == (0, 0.0)
