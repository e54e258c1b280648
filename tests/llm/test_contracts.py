"""Every registered text query on a small table with odd rows, against brute force written from the contract alone."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from eventide.llm import winnowing
from eventide.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def fold(doc_id, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def rows(df, *columns) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_an_empty_result(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op6_html", "op11_whitening", "op13_collocations"}))
def test_each_document_has_one_row(spark, edge, documents, name):
    found = Counter(r["doc_id"] for r in QUERIES[name](spark, edge).select("doc_id").collect())
    assert found == Counter(d for d, _ in documents)


def test_each_remaining_vector_has_its_components(spark, edge):
    own = pq.read_table(os.path.join(edge, "embeddings.parquet"), columns=["vec_id", "embedding"]).to_pydict()
    width = Counter(len(v) for v in own["embedding"] if v).most_common(1)[0][0]
    kept = Counter(i for i, v in zip(own["vec_id"], own["embedding"]) if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v))
    found = QUERIES["op11_whitening"](spark, edge).collect()
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter({(i, c): n for i, n in kept.items() for c in range(1, 33)})
    assert {r["n"] for r in found} == {sum(kept.values())} and max(r["identity_error"] for r in found) < 1e-4


def test_toxicity_columns(spark, edge):
    for r in QUERIES["op1_toxicity"](spark, edge).collect():
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_token_ids(spark, edge, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = [(d, [*own.encode(t, add_special_tokens=False).ids, 1]) for d, t in documents]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    starts, before, want = {}, 0, Counter()
    for d, ids in encoded:
        starts.setdefault(d, []).append(before)
        before += len(ids)
        want[d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    found = QUERIES["op2_token_ids"](spark, edge).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = sorted((r["start"], r["n_tokens"]) for r in found)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    for d, own in starts.items():
        if len(own) == 1:
            assert [r["start"] for r in found if r["doc_id"] == d] == own


def test_unigram_base(spark, edge, documents):
    counts = Counter()
    for d, t in documents:
        if fold(d, 7) != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in documents:
        own = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want[d, fold(d, 7) == 2, len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)] += 1
    found = QUERIES["op3_ppm"](spark, edge).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] <= 0 for r in found)


def test_model_tells_held_out_texts_better_than_the_base(spark):
    """Over ten thousand texts. The base gives all unseen words together one count, so on few texts it is hard to beat."""
    out = [r for r in QUERIES["op3_ppm"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_pieces_decode_to_the_text(spark, edge, documents):
    found = QUERIES["op4_sentencepiece"](spark, edge)
    assert rows(found, "doc_id", "decoded") == Counter(documents)
    assert rows(found, "doc_id", "ids_crc32") == rows(QUERIES["op4_sentencepiece"](spark, edge).repartition(3), "doc_id", "ids_crc32")


def test_contamination(spark, edge, documents):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = pq.read_table(os.path.join(edge, "benchmark.parquet")).to_pylist()
    windows: dict[tuple, set] = {}
    for i in items:
        own = word(i["text"] or "")
        if i["item_id"] is not None and own:
            for k in range(max(1, len(own) - 12)):
                windows.setdefault(tuple(own[k : k + 13]), set()).add(str(i["item_id"]))
    want = Counter()
    for d, t in documents:
        own, hit, names = word(t), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if found := windows.get(tuple(own[k : k + size])):
                    names |= found
                    hit.update(range(k, k + size))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[d, len(own), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(own)] += 1
    found = QUERIES["op5_decontamination"](spark, edge)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(r["contaminated"] for r in found.collect()) >= 3


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    assert differences(spark, small, QUERIES[name], ORACLE_SQL[name]) == ""


def test_contamination_in_blocks_of_phrases(spark, edge):
    from eventide.llm.common import table
    from eventide.llm.fmindex import contamination

    docs, items = table(spark, edge, "documents"), table(spark, edge, "benchmark")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(contamination(docs, items, block_bytes=2000), *columns) == rows(contamination(docs, items), *columns)


def test_main_text_of_odd_pages(spark, edge):
    found = {r["page_id"]: r for r in QUERIES["op6_html"](spark, edge).collect()}
    assert QUERIES["op6_html"](spark, edge).count() == pq.read_table(os.path.join(edge, "pages.parquet")).num_rows
    assert found[9_004]["text"] == "One & two three"
    assert [found[i]["text"] for i in (9_000, 9_001, 9_005)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_main_text_is_the_article(spark, middle):
    """The table's pages mark the article by its element: what it holds, tags taken out, is the main text."""
    import html

    pages = {r["page_id"]: r["html"] for r in pq.read_table(os.path.join(middle, "pages.parquet")).to_pylist()}
    for r in QUERIES["op6_html"](spark, middle).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub(r"</?[bi]>", "", x))).strip() for x in re.split(r"</?(?:p|h1|h2|br)>", article))
        assert r["text"] == " ".join(p for p in parts if p)


def simhash(text: str) -> int:
    own = words(text)
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, edge, documents):
    prints = [simhash(t) for _, t in documents]
    component = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and component[j] > component[i]:
                    component[j], changed = component[i], True
    least: dict[int, list] = {}
    for (d, _), c in zip(documents, component):
        least.setdefault(c, []).extend([] if d is None else [d])
    want = Counter((d, f"{p:016x}", min(least[c], default=None)) for (d, _), p, c in zip(documents, prints, component))
    assert rows(QUERIES["op7_simhash"](spark, edge), "doc_id", "fingerprint", "component_id") == want


def test_suffix_dedup(spark, edge, documents):
    """A null doc_id neither removes nor loses anything."""
    first: dict[bytes, int] = {}
    for d, t in documents:
        if d is None:
            continue
        raw = t.encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            first[s] = min(first.get(s, d), d)
    want = Counter()
    for d, t in documents:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        reach = 0
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[max(i, reach) : i + 50] = b"\1" * (i + 50 - max(i, reach))
                reach = i + 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    assert rows(QUERIES["op9_suffix_dedup"](spark, edge), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_winnowing(spark, edge, documents):
    found = QUERIES["op10_winnowing"](spark, edge).collect()
    ids = [d for d, _ in documents]
    text = {d: t for d, t in documents if ids.count(d) == 1}
    order = sorted((d for d in set(ids) if d is not None), reverse=True)
    checked = 0
    for r in found:
        d = r["doc_id"]
        if d is None or d not in text:
            continue
        at = order.index(d)
        if at + 1 < len(order) and order[at + 1] in text:
            t, following = text[d], text[order[at + 1]]
            half = len(t) // 2
            assert r["n_chars"] == len(t)
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
            checked += 1
    assert checked > 150
    by_text: dict[str, set] = {}
    for r in found:
        if r["doc_id"] in text:
            by_text.setdefault(text[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())


def winnowed(text: str) -> list[tuple[int, int]]:
    """(hash, place) of the rightmost least gram of each window, by looking at all windows."""
    raw = text.encode()
    if not raw:
        return []
    hashes = (winnowing.gram_hashes(np.frombuffer(raw, np.uint8), min(12, len(raw))) >> np.uint64(32)).tolist()
    size = min(24, len(hashes))
    chosen = {max(range(i, i + size), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - size + 1)}
    return [(hashes[j], j) for j in sorted(chosen)]


def alike(a: list, b: list) -> float:
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_winnowing_of_edited_texts(spark, small):
    """Fingerprints, likeness and the step from the last document to the first, by brute force."""
    docs = pq.read_table(os.path.join(small, "documents.parquet"), columns=["doc_id", "text"]).to_pylist()[:60]
    text = {r["doc_id"]: (r["text"] or "")[:1500] for r in docs} | {10**6: "", 10**6 + 1: "ab", 10**6 + 2: "the same twelve bytes " * 9}
    found = winnowing.edited_fingerprints(spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(4)).collect()
    order = sorted(text, reverse=True)
    assert sorted(r["doc_id"] for r in found) == sorted(text)
    for r in found:
        own, following = text[r["doc_id"]], text[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(own) // 2
        new = own[: len(own) - half] + following[:half]
        a, b, c = winnowed(own), winnowed(new), winnowed(following)
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for fingerprint, want in ((r["fingerprint"], a), (r["edited_fingerprint"], b)):
            back = winnowing.decode(fingerprint)
            assert list(zip(back.hashes.tolist(), back.positions.tolist())) == want
        assert r["near_edited"] == pytest.approx(alike(a, b)) and r["near_next"] == pytest.approx(alike(a, c))


def test_pseudonyms(spark, edge, documents):
    found = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, edge).collect() if r["doc_id"] is not None}
    plain = [d for d, t in documents if d is not None and not re.search("[0-9@]", t)]
    assert plain and all(found[d]["n_replaced"] == 0 for d in plain)
    assert any(r["n_replaced"] for r in found.values())
