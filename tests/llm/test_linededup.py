import random

import numpy as np
import pyarrow as pa

from profilark.functions.cluster import table
from profilark.llm import linededup
from profilark.llm.linededup import LineDedup
from profilark.llm.queries import queries
from tests.llm import brute


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = brute.removed_lines(rows, 80)
    text = dict(rows)
    for r in queries()["op2_line_dedup"](spark, small).collect():
        assert r.removed_lines == want.get(r.doc_id, [])
        assert r.text == "\n".join(x for k, x in enumerate(text[r.doc_id].split("\n")) if k not in set(r.removed_lines))


def test_families_and_hot_words(spark):
    """Lines that share most words, so that one word stands in hundreds of prefixes."""
    r = random.Random(2)
    rows = []
    for d in range(120):
        lines = []
        for _ in range(6):
            base = [f"f{r.randrange(3)}w{k}" for k in range(r.choice([4, 5, 9, 14]))]
            for _ in range(r.choice([0, 0, 1, 2])):
                base[r.randrange(len(base))] = f"x{r.randrange(400)}"
            r.shuffle(base)
            lines.append(" ".join(base))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 20, 10_000):
        got = {x.doc: x.lines for x in LineDedup(percent=80, hot=hot).removed(df).collect()}
        assert got == brute.removed_lines(rows, 80)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "\n\n \n", "c"), (4, "one two three four five\nOne  TWO three four five", "d"), (5, "x\none two three four\n", "e"), (None, "x\nx", "f"), (6, "x\r\nX", None), (7, "y", "g"), (7, "y", "g"), (8, "two one five four three", "h")]
    rows.append((9, "\n".join(["long " * 3000 + str(k) for k in range(3)]), "i"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = sorted((tuple(r) for r in LineDedup().run(df).collect()), key=repr)
    assert len(got) == len(rows)
    by = {(r[0], r[2]): r for r in got}
    assert by[1, "a"][1] is None and by[3, "c"][1] == "\n\n \n" and not by[3, "c"][4]
    assert by[4, "d"][1] == "one two three four five" and by[4, "d"][3] == [1]
    assert by[5, "e"][1] == "x\n" and by[5, "e"][3] == [1]
    assert by[None, "f"][1] == "x\nx"
    assert by[6, None][1] == "" and by[6, None][3] == [0, 1] and by[6, None][4]
    assert by[7, "g"][1] == "y" and by[8, "h"][4]
    assert by[9, "i"][3] == []  # {long, 0}, {long, 1}, {long, 2}
    assert LineDedup().run(df.limit(0)).count() == 0


def test_long_lines_that_differ_in_rare_words(spark):
    """Lines at the edge of the threshold whose unshared words are the rarest, so that prefixes barely meet."""
    r = random.Random(9)
    rows, common = [], [f"c{k}" for k in range(400)]
    for d in range(90):
        n = r.choice([47, 48, 60, 96, 97, 150, 200, 260])
        base = common[:n] if d % 2 else r.sample(common, n)
        for k in range(r.choice([0, 1, n // 12, n // 10, n // 9 + 1])):
            base[k] = f"rare{d}x{k}"
        rows.append((d, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.removed_lines(rows, 80)
    assert 10 < len(want) < 60
    for hot in (2, 256):
        assert {x.doc: x.lines for x in LineDedup(hot=hot).removed(df).collect()} == want


def test_packed_buckets_give_all_pairs(monkeypatch):
    """Rows packed by few at a time; bounds on pairs; keys of two numbers; hot words stay out, no other does."""
    monkeypatch.setattr(linededup, "PAIRS", 5)
    monkeypatch.setattr(linededup, "ROWS", 50)
    r = random.Random(5)
    words = [-9, -1, 0, 4, 2**62, -(2**62), 77]

    class Hot:
        value = np.array([-9, 77], np.int64).tobytes()

    for composite in False, True:
        lines = []
        for k in range(150):
            n, doc = r.choice([8, 9, 10, 60]), r.randrange(30) - 15
            lines.append(((doc % 3, doc) if composite else doc, k, n, r.choice([0, 1, 7, -1]), r.sample(words, r.randrange(4)) + [10**6 + k]))
        kind = pa.struct([("id", pa.int64()), ("text_hash", pa.int64())]) if composite else pa.int64()
        docs = [{"id": x[0][0], "text_hash": x[0][1]} if composite else x[0] for x in lines]
        kinds = [kind, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        whole = pa.RecordBatch.from_arrays([pa.array(docs if k == 0 else [x[k] for x in lines], t) for k, t in enumerate(kinds)], names=["doc", "line", "n", "bits", "prefix"])
        want, p = [], 80
        for d, line, na, bits, prefix in lines:
            for d2, line2, nb, bits2, prefix2 in lines:
                apart, asked = ((bits ^ bits2) & (2**64 - 1)).bit_count(), 1 + min(min(na, nb) // 48, 3)
                for t in set(prefix) & set(prefix2) - {-9, 77}:
                    left = min(na - prefix.index(t), nb - prefix2.index(t))
                    near = apart * (100 + p) <= (na + nb) * (100 - p) and na * 100 >= nb * p and nb * 100 >= na * p
                    if (d, line) < (d2, line2) and near and (left + asked - 1) * (100 + p) >= p * (na + nb):
                        want.append((d, line, d2, line2, apart, asked))
        for step in 7, 1000:
            packed = {}
            for b in linededup._packed(3, Hot)(whole.slice(k, step) for k in range(0, len(whole), step)):
                for bucket in b.column(0).unique().to_pylist():
                    packed.setdefault(bucket, []).append(b.filter(pa.array([x == bucket for x in b.column(0).to_pylist()])))
            assert len(packed) == 3
            meet = linededup._meet(80, ["id", "text_hash"] if composite else [])
            got = [x for bucket, bs in packed.items() for b in meet((bucket,), iter(bs)) for x in b.to_pylist()]
            flat = lambda d: tuple(d.values()) if composite else d
            got = [(flat(x["a_doc"]), x["a_line"], flat(x["b_doc"]), x["b_line"], x["apart"], x["asked"]) for x in got]
            assert len(want) > 100 and sorted(got) == sorted(want)
