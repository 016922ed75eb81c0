import random
import re

from profilark.llm.decontaminate import Decontaminator
from tests.llm import brute


def expected(docs, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t))

    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_blocks_equal_brute_force(spark):
    r = random.Random(5)
    vocab = ["the", "of", "É", "x1", "Zwei"] + [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 6, 9, 30])))) for k in range(60)] + [(None, None), (7, None), (None, "the of x1 x1"), (3, "the of, X1-x1")]
    docs = []
    for k in range(150):
        t = [r.choice(vocab) for _ in range(r.choice([0, 2, 30, 200]))]
        for _ in range(r.choice([0, 1, 2])):
            at = r.randrange(len(t) + 1)
            t[at:at] = (r.choice(items)[1] or "").split()
        docs.append((k, ". ".join(t) if k % 2 else " ".join(t)))
    docs += [(None, None), (1, "dup"), (1, "dup"), (999, "the " * 30000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS marks", "text AS items")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = expected(docs, items, 6)
    for size in (1 << 20, 1000):
        got = Decontaminator(window=6, block_bytes=size).run(d, i).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got), key=repr) == want
        assert all(sum(s["last"] - s["first"] + 1 for s in x.spans or []) == x.n_hit for x in got)
    assert Decontaminator().run(d, i.limit(0)).where("n_hit > 0").count() == 0
    assert Decontaminator().run(d.limit(0), i).count() == 0
