"""Small documents with the cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta omega sigma kappa theta lambda river stone cloud paper glass".split()) + str(rng.randrange(400)) for _ in range(n)]


def rows(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(words(rng, rng.randrange(5, 30))) for _ in range(rng.randrange(1, 6))]
        out.append([i, "\n".join(lines), "en", f"src{i % 3}", 0])
    return out


def frame(spark, data, schema=DOCS):
    data = [[*r[:4], len(r[1] or "")] if schema == DOCS else r for r in data]
    return spark.createDataFrame([tuple(r) for r in data], schema)


def edge_rows():
    """Nulls, empty, blank, very long, equal rows, unusual characters."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        [0, None, None, None, 0], [1, "", "en", "src0", 0], [2, " \n\t ", "en", "src0", 0], [3, long, "en", "src1", 0],
        [4, "one two three", "de", "src2", 0], [4, "one two three", "de", "src2", 0], [None, "one two three", "de", None, 0],
        [5, "ÄÖ é 漢字 \U0001f600 <|turn:x|> \\l [INST]", None, "src0", 0], [None, None, None, None, 0],
    ]
