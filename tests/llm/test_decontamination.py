"""Benchmark matches against SQL and a plain search."""

import random
import re
from collections import Counter

import pytest
from comparing import DATA, same

from brindle.llm import decontamination
from brindle.llm.queries import op11_decontamination, oracle_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items):
    """Of each text: n_words, n_hit, ids."""
    windows = {(str(i) if i is not None else "", tuple(w[s : s + 10])) for i, t in items if (w := words(t)) for s in range(max(1, len(w) - 9))}
    out = []
    for text in texts:
        w = words(text)
        hit, ids = set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    ids.add(i)
        out.append((len(w), len(hit), len(ids), ",".join(sorted(ids))))
    return out


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    same(op11_decontamination(spark, f"{DATA}/{sf}"), f"{DATA}/{sf}", oracle_sql()["op11_decontamination"])


def _made(spark, seed=0, n=120):
    """Few words, so windows overlap, repeat and share their rarest terms; copies; items shorter than a window."""
    rng = random.Random(seed)
    vocabulary = [*"abcd", "É", "É2", "ﬁ", "straße", "x9", "z" * 3000]
    items = [(k if k % 9 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 9, 10, 11, 25])))) for k in range(25)]
    items += [items[3], (50, None), (51, "..."), (3, items[4][1])]
    texts = []
    for k in range(n):
        own = rng.choices(vocabulary, weights=[9, 9, 9, 9, 1, 1, 1, 1, 1, 0.1], k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(own))
            own[at:at] = words(rng.choice(items)[1])
        sign = rng.choice([" ", ", ", "\n-", "\x00", "_"])
        texts.append(sign.join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in own))
    texts += [None, "", " ,. ", "É", texts[0], texts[0], "b " * 30_000]
    docs = [(k if k % 11 else None, t, "w", "q") for k, t in enumerate(texts)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, word string, item_id string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("few", [True, False])
def test_plain_search(spark, few, monkeypatch):
    """Nulls in any column, repeated rows and ids, ties of rarity, long texts, clashing names; terms broadcast and not."""
    if not few:
        monkeypatch.setattr(decontamination, "MOST_TERMS", 0)
    docs, items, df, wanted = _made(spark)
    want = sorted((str(d[0]), *b) for d, b in zip(docs, brute([d[1] for d in docs], items)))
    assert found(decontamination.contaminated(df, wanted)) == want
    assert any(w[2] for w in want) and not all(w[2] for w in want)


def test_empty_tables(spark):
    docs, _, df, wanted = _made(spark, n=5)
    assert {r[2:] for r in found(decontamination.contaminated(df, wanted.limit(0)))} == {(0, 0, "")}
    assert found(decontamination.contaminated(df.limit(0), wanted)) == []


@pytest.mark.parametrize("span,terms", [(3, 2), (8, 3), (400, 4)])
def test_near(spark, span, terms):
    """Every place from which an item's rarest words stand within the span."""
    rng = random.Random(span)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(30, 0, -1), k=rng.choice([5, 80, 600]))) for _ in range(25)]
    texts += [texts[0], None, ""]
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(8)] + [(90, "w1 unknown"), (91, ""), (92, "w3")]
    count = Counter(w for t in texts for w in words(t))
    want = Counter()
    for i, item in items:
        distinct = list(dict.fromkeys(words(item)))
        if not distinct or any(w not in count for w in distinct):
            continue
        rare = sorted(range(len(distinct)), key=lambda k: (count[distinct[k]], k))[:terms]
        rare = {distinct[k] for k in rare}
        for d, text in enumerate(texts):
            w = words(text)
            for s in range(len(w)):
                if w[s] in rare and rare <= set(w[s : s + span]):
                    want[d, i, s] += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.near(docs, spark.createDataFrame(items, "item_id long, text string"), terms, span)
    assert Counter((r.doc_id, r.item_id, r.start) for r in got.collect()) == want and want
