"""Like labels: no pair is lost against every pair, and few pairs are compared."""

import random
from difflib import SequenceMatcher

import pytest

from signflow.operators.reconcile import candidates


def frame(spark, labels):
    return spark.createDataFrame([(x,) for x in labels], "label string")


@pytest.mark.parametrize("fuzzy", [0.86, 0.75, 0.6])
def test_no_pair_is_lost(spark, fuzzy):
    rng = random.Random(3)
    words = ["blood", "plasma", "glucose", "pressure", "renal", "flow", "aa", "b", "éa", "x1", "potassium", "level"]
    labels = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(90)] + [" ".join(sorted(rng.sample(words, rng.randint(1, 4)))) for _ in range(90)]
    edited = []
    for x in labels:
        y = list(x)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = rng.choice("abz ")
        edited.append("".join(y) or "b")
    got = {tuple(r) for r in candidates(frame(spark, [*labels, "", None]), frame(spark, [*edited, ""]), fuzzy).collect()}
    want = {(a, b) for a in set(labels) for b in set(edited) if SequenceMatcher(None, a, b).ratio() >= fuzzy}
    assert want <= got and len(want) > 100


def test_few_pairs_are_compared(spark, sf_dir):
    # 3,000 labels of the documents' words, and as many with a slip
    rng = random.Random(1)
    words = sorted({w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in (r.text or "").lower().split() if w.isalpha()})
    labels = sorted({" ".join(sorted(rng.sample(words, rng.randint(2, 4)))) for _ in range(3000)})
    slips = [x[: len(x) // 2] + x[len(x) // 2 + 1 :] for x in labels]
    n = candidates(frame(spark, labels), frame(spark, slips)).count()
    assert len(labels) <= n < 0.01 * len(labels) ** 2
