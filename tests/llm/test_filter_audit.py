import random
import re
from itertools import permutations

from kalends.llm.filter_audit import METRICS, audit


def brute(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    fails = {
        "A": lambda i, t: len(words(t)) < 100, "B": lambda i, t: 100 * len(set(words(t))) < 80 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)), "E": lambda i, t: i is not None and any(k < i for k in ids[t]),
    }
    rows = [(lang or "", {f for f, test in fails.items() if test(i, t or "")}, any(q == 1 for k, q, _ in labels if k == i and i is not None), any(x == 1 for k, _, x in labels if k == i and i is not None)) for i, t, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, removed_by = [r[1:] for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                now = [r for r in own if not r[0] & before and f in r[0]]
                removed_by[f] += len(now)
                out[part, "".join(order), k + 1] = [
                    sum(not r[0] & (before | {f}) for r in own), len(now), sum(f in r[0] and bool(r[0] & before) for r in own), sum(r[0] == {f} for r in own), sum(r[1] for r in now), sum(r[2] for r in now)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)

    def text():
        kind, n = rng.random(), rng.choice([5, 99, 100, 101, 200])
        w = [rng.choice(["the", "of"]) if rng.random() < rng.choice([0, 0.15, 0.3]) else f"w{i}" for i in range(n)]
        t = rng.choice([" ", "\n", "\t \x0b"]).join(w)
        return t.upper() if kind < 0.2 else t + " é#" if kind < 0.3 else t

    docs = [(i, text(), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    docs += [(150 + i, docs[i % 9][1], rng.choice(["en", "fr"])) for i in range(40)]  # copies
    docs += [(3, "again", "en"), (3, "again", "en"), (3, "again", "fr"), (2, "again", "en"), (400, None, "en"), (401, "", "en"), (402, None, "de"), (None, "again", "en"), (None, "again", "en"), (None, None, "en")]
    docs += [(500, "A" * 50_000 + " b" * 60_000, "xx")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(*r, "mask") for r in docs], "doc_id long, text string, lang string, mask string")
    g = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [r[m] for m in METRICS] for r in audit(d, g).collect()}
    assert got == brute(docs, labels)
    assert audit(d.limit(0), g).collect() == []
    none = audit(d, g.limit(0)).collect()
    assert len(none) == len(got) and not any(r.good_lost or r.toxic_lost for r in none)
