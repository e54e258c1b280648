"""The index family of suffix arrays, and the steps around it, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import suffixdedup as own


def brute(docs, length):
    """(doc_id, bytes, removed, runs) by looking every string up."""
    first = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            if d is not None:
                first[t[i : i + length]] = min(first.get(t[i : i + length], d), d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if d is not None and first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return sorted(out, key=str)


def table(chunk, rows):
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.binary())})


def steps(docs, length, k, chunks, shares):
    """All steps of :func:`remove_repeats` over chunks and shares, without a cluster."""
    parts = [table(c, docs[c::chunks]) for c in range(chunks) if docs[c::chunks]]

    def dealt(tables):
        rows = sorted((x for t in tables for x in t.to_pylist()), key=lambda x: (x["share"], x["chunk"]))
        return [pa.RecordBatch.from_pylist(rows[i : i + 3], schema=tables[0].schema) for i in range(0, len(rows), 3)]

    def of(found, c):
        return pa.Table.from_batches(found).filter(pa.compute.equal(pa.Table.from_batches(found).column("chunk"), c))

    shared = list(own._repeated(dealt([own._fingerprints(length, k, shares)(p) for p in parts])))
    if not shared:
        return None
    arrays = [own._suffix_arrays(length, k, shares)(p, of(shared, p.column("chunk")[0].as_py())) for p in parts]
    answers = list(own._merge_scan(length, k)(dealt(arrays)))
    if not answers:
        return None
    out = [own._remove(length, False)(p, of(answers, p.column("chunk")[0].as_py())) for p in parts]
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"]) for t in out for x in t.to_pylist()), key=str)


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_all_strings_are_found(hot, monkeypatch):
    """Few letters and shared parts: suffixes that begin alike in many documents, with all kinds of surroundings."""
    monkeypatch.setattr(own, "HOT", hot)
    monkeypatch.setattr(own, "SLICE", 256)
    r = random.Random(9)
    for _ in range(40):
        length, k = r.choice([(50, 20), (12, 5), (20, 8)])
        shared = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randrange(5, 80))) for _ in range(6)]
        docs = []
        for i in range(40):
            text = b"".join(r.choice(shared) if r.random() < 0.7 else bytes(r.choice(b"abcdefgh") for _ in range(r.randrange(30))) for _ in range(r.randrange(6)))
            docs.append((r.choice([None, *range(30)]) if r.random() < 0.2 else i, text))
        found = steps(docs, length, k, r.choice([1, 2, 5]), r.choice([1, 3]))
        want = brute(docs, length)
        assert found == want or (found is None and not any(x[2] for x in want))


def test_levels_are_ordered_by_suffix_and_grow_geometrically():
    r = random.Random(4)
    form, family, all_ = own.Records(50, 20), own.Family(), {}
    for i in range(1, 14):
        text = bytes(r.choice(b"ab") for _ in range(3000))
        batch = own.sampled([(i, text)], 50, 20)
        values = np.unique(form.strings(form.of(batch, batch.first, batch.count, batch.at)))
        for value, number in zip(values.tolist(), family.add(values).tolist()):
            assert all_.setdefault(value, number) == number
        sizes = [level.size for level in family.levels]
        assert sum(sizes) == i and sizes == sorted(set(sizes), reverse=True) and all(s & (s - 1) == 0 for s in sizes)
        for level in family.levels:
            suffixes = [x[:50].tobytes() for x in form.rows(level.suffixes)]
            assert suffixes == sorted(suffixes)
    assert family.n == len(all_)
    whole = family.whole()
    assert dict(zip(whole.suffixes.tolist(), whole.numbers.tolist())) == all_


def test_records_keep_all_bytes():
    text = bytes(random.Random(2).randrange(256) for _ in range(500))
    form, batch = own.Records(50, 20), own.sampled([(1, text[:9]), (2, text)], 50, 20)
    records = form.of(batch, batch.first, batch.count, batch.at)
    starts = set()
    for r, first, count in zip(records, batch.first.tolist(), batch.count.tolist()):
        assert form.text(r) == batch.data[first : first + count + 49].tobytes() and form.starts(r[None])[0] == count
        starts |= set(range(first, first + count))
    assert starts == set(range(int(batch.base[1]), int(batch.base[1]) + 451))


def test_length_must_fit_its_byte():
    with pytest.raises(ValueError, match="255"):
        own.remove_repeats(None, 256, 20)
