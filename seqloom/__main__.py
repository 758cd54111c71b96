"""python -m seqloom -m makedb|clustering|fast [-f FASTA] [-p PACKED] [-r RESULT] [-i IDENTITY] [-b BANDS]"""

from __future__ import annotations

import sys


def parse(args: list[str]) -> dict[str, str]:
    """Flags and the words after them; the last of equal flags counts and unknown ones are ignored."""
    out = {"-m": "", "-f": "data.fasta", "-p": "packed", "-r": "result", "-i": "95", "-b": "64"}
    for flag, value in zip(args, args[1:], strict=False):
        if flag in out:
            out[flag] = value
    return out


def number(text: str) -> int:
    digits = ""
    for c in text.strip():
        if not (c.isdigit() or c in "+-" and not digits):
            break
        digits += c
    return int(digits) if digits.strip("+-") else 0


def main(args: list[str]) -> int:
    """The exit code: 0 also where input is refused before any work, 1 where work fails."""
    from pyspark.sql import SparkSession

    from .api import SequenceEngine
    from .operators.base import InvalidInput

    o = parse(args)
    if o["-m"] not in ("makedb", "clustering", "fast"):
        print(__doc__)
        return 0
    engine = SequenceEngine(SparkSession.builder.appName("seqloom").getOrCreate())
    try:
        if o["-m"] == "makedb":
            engine.makedb(o["-p"], fasta_path=o["-f"]).show()
        else:
            run = engine.clustering if o["-m"] == "clustering" else engine.fast
            run(o["-p"], number(o["-i"]), number(o["-b"]), o["-r"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 0 if isinstance(e, InvalidInput) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
