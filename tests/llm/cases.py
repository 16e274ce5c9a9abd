"""Small documents with the awkward cases all operators have to bear."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, key string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = prose(rng, 80)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "ein zwei", "é ü ñ  x", "...", "a" * 5000]
    texts += [prose(rng, n) for n in (5, 49, 50, 51, 200, 20_000)]
    texts += [shared, shared, f"{prose(rng, 30)} {shared}", f"{shared}\n{prose(rng, 30)}", shared.replace(" ", "\n")]
    texts += [f"{prose(rng, 60)}\n{prose(rng, 60)}" for _ in range(8)]
    texts += ["same line here with seven words\n" * 6, "#*$%&|<> tag", "MIT  License and mit licence; CC-BY x Apache License"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), i, "r", 3, "k") for i, t in enumerate(texts)]
    rows += [rows[16], rows[3], (None, shared, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, COLUMNS)


def sf(name: str = "sf0.001") -> str:
    return f"/root/testdata/{name}"
