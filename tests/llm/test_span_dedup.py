import hashlib

import numpy as np
import pytest

from ruleflow.llm import span_dedup as dedup


def slow_removed(docs):
    """For each row the bytes covered by a 50-byte string that starts in a row with a smaller id."""
    first = {}
    ids = [dedup.LAST_ID if i is None else i for i, _ in docs]
    data = [(t or "").encode() for _, t in docs]
    for i, text in zip(ids, data, strict=True):
        for p in range(len(text) - 49):
            w = text[p : p + 50]
            first[w] = min(first.get(w, i), i)
    found = []
    for i, text in zip(ids, data, strict=True):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < i:
                gone[p : p + 50] = True
        found.append(gone)
    return found


def slow_rows(docs):
    rows = []
    for (i, t), gone in zip(docs, slow_removed(docs), strict=True):
        text = np.frombuffer((t or "").encode(), np.uint8)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        rows.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
    return sorted(rows, key=str)


def corpus(seed, n=60, letters="abcdé "):
    rng = np.random.default_rng(seed)
    some = lambda k: "".join(rng.choice(list(letters), k))
    passages = [some(int(k)) for k in (49, 50, 51, 80, 200, 700)]
    docs = []
    for i in rng.permutation(n).tolist():
        parts = [some(int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(0, len(passages)))]
            low = int(rng.integers(0, 30))
            parts += [p[low : low + int(rng.integers(30, 300))], some(int(rng.integers(0, 40)))]
        docs.append((int(i), "".join(parts)))
    docs += [(5, docs[0][1]), (1000, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (2000, None), (2001, ""), (2002, "a" * 400)]
    docs += [(2003, "b" + "a" * 120), (2004, "a" * 49), (3, "a" * 55), (2005, "ab" * 100), (2006, "ab" * 30 + "c")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_bytes string")


@pytest.mark.parametrize(("seed", "hot"), [(0, 500), (1, 3)])
def test_rows_equal_comparing_all_windows(spark, seed, hot, monkeypatch):
    docs = corpus(seed)
    monkeypatch.setattr(dedup, "HOT_DOCUMENTS", hot)
    got = sorted(map(tuple, dedup.remove_repeats(frame(spark, docs).repartition(3)).collect()), key=str)
    assert got == slow_rows(docs)


def whole(docs, chunk_rows, buckets, monkeypatch):
    """The steps without Spark, over chunks of some rows."""
    state = []
    for at in range(0, len(docs), chunk_rows):
        part = docs[at : at + chunk_rows]
        data = [(t or "").encode() for _, t in part]
        row = {"chunk": at, "ids": [i for i, _ in part], "sizes": [len(d) for d in data], "data": dedup.squeeze(np.frombuffer(b"".join(data), np.uint8))}
        state.append(row)
    batch = lambda rows: [dedup.pa.RecordBatch.from_pylist(rows)]
    by = lambda tables: sorted((r for t in tables for r in t.to_pylist()), key=lambda r: (r["bucket"], r["chunk"]))

    def tell(rows, answers):
        return [{**r, "answers": [{"bucket": a["bucket"], "data": a["data"]} for a in answers if a["chunk"] == r["chunk"]]} for r in rows]

    schema = dedup.pa.schema([("chunk", dedup.pa.int64()), ("bucket", dedup.pa.int32()), ("data", dedup.pa.binary())])
    batch_parts = lambda rows: [dedup.pa.RecordBatch.from_pylist(rows, schema)]
    asked = by(dedup.send_anchors(buckets)(batch(state)))
    shared = by(dedup.answer_anchors(batch_parts(asked)))
    sent = by(dedup.send_runs(buckets)(batch(tell(state, shared))))
    marked = by(dedup.answer_runs(batch_parts(sent)))
    return sorted((tuple(r.values()) for t in dedup.remove(False)(batch(tell(state, marked))) for r in t.to_pylist()), key=str)


@pytest.mark.parametrize("seed", range(2, 10))
def test_steps_equal_comparing_all_windows(seed, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_DOCUMENTS", [500, 2, 6][seed % 3])
    monkeypatch.setattr(dedup, "BLOCK_BYTES", [1 << 20, 60, 333][seed % 3])
    docs = corpus(seed, letters="ab" if seed == 5 else "abcdé ")
    assert whole(docs, 1 + seed, 1 + seed % 4, monkeypatch) == slow_rows(docs)


def test_smaller_neighbours():
    rng = np.random.default_rng(0)
    for _ in range(200):
        values = rng.integers(0, 6, rng.integers(0, 30))
        before = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        after = [min((j for j in range(i + 1, len(values)) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert dedup.previous_smaller(values).tolist() == before
        assert dedup.next_smaller(values).tolist() == after


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 99, (60, 12)).astype(np.uint8)
    order = rng.integers(0, 9, 60)
    prefix = lambda a, b: int(np.argmin(np.r_[a == b, False]))
    wanted = [max((prefix(windows[i], windows[j]) for j in range(60) if order[j] < order[i]), default=0) for i in range(60)]
    assert dedup.longest_previous(windows, order).tolist() == wanted


def test_anchors_equal_the_smallest_hash_of_each_window():
    data = np.random.default_rng(2).integers(0, 256, 400).astype(np.uint8)
    lane = [int.from_bytes(data[i : i + 8].tobytes().ljust(8, b"\0"), "little") for i in range(len(data))]
    assert dedup.lanes(data).tolist() == lane
    hashes = [dedup.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0] for a, b in zip(lane, lane[8:], strict=False)]
    assert dedup.anchors(data).tolist() == [int(min(hashes[i : i + dedup.SPAN])) for i in range(len(data) - 49)]


def test_texts_and_empty_table(spark):
    passage = "one passage of more than fifty bytes that is in both of them, é"
    docs = frame(spark, [(1, f"{passage} first"), (2, f"second {passage} end"), (3, None)])
    found = {r.doc_id: r.kept_text for r in dedup.remove_repeats(docs, with_text=True).collect()}
    assert found == {1: f"{passage} first", 2: "second end", 3: ""}
    assert dedup.remove_repeats(docs.limit(0)).count() == 0
