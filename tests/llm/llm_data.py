"""Small documents with every awkward case, and the folder layout that the queries read."""

import random

import pandas as pd

WORDS = "the of and to in is was for é ñandú über straße naïve don't it's 12 3.5 foo, bar. idiot (c) ﬁ 日本 😀".split()


def rows(seed: int = 0, n: int = 60) -> pd.DataFrame:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "\n", "  \t\n ", "a", "A  b\n\nc ", "word " * 30, "<|endoftext|> x<|startoftext|>y </s>", "▁ x▁▁y ", "z" * 3000, "a\x1cb \x85c\xa0 d", "İΣσς ́x", "日本" * 300, "x\n y\n\t z \n \nw"]
    texts += ["".join(w + rng.choice([" "] * 12 + ["\n", "  ", ". "]) for w in rng.choices(WORDS, k=rng.choice([3, 40, 200]))) for _ in range(n)]
    texts += [" ".join(rng.choices(WORDS, k=9000))]
    texts += [texts[20], texts[20], texts[20].replace(" ", "\t", 3), texts[21], None]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return pd.DataFrame({"doc_id": ids, "text": texts, "lang": [rng.choice(["en", "de", None]) for _ in ids], "source": [rng.choice(["s0", "s0", "s1", None]) for _ in ids], "n_chars": [len(t or "") for t in texts]})


def frame(spark, pdf: pd.DataFrame):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)], schema)
