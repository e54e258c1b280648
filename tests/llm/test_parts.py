"""Parts of the operators against brute force, finite differences and exact round trips."""

import itertools
import math
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.llm import mainhtml, ppm, tokenids, toxicity, winnowing
from eventide.llm.labelled import bare_pages, labelled_pages


def test_toxicity_gradient():
    texts = [b"you vile thing. fine day", b"a fine day. all good", b"vile vile. no", b"good thing here"]
    known = {w: i for i, w in enumerate(sorted({w for t in texts for w in toxicity.marked_words(t)} - {toxicity.STOP}))}
    own, sentence, document = [], [], []
    for d, t in enumerate(texts):
        document.append(d)
        for w in toxicity.marked_words(t):
            if w == toxicity.STOP:
                document.append(d)
            else:
                own.append(known[w])
                sentence.append(len(document) - 1)
    bags = toxicity.Bags(np.array(own), np.array(sentence), np.array(document), np.array([1.0, 0, 1, 0]), np.array([2.0, 2, 70, 1]))
    theta = np.random.default_rng(1).normal(0, 0.5, len(known) + 3)
    slope = toxicity.gradient(theta, bags)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert slope[i] == pytest.approx((toxicity.loss(theta + step, bags) - toxicity.loss(theta - step, bags)) / 2e-6, abs=1e-5)


def test_toxicity_tells_held_out_documents_apart(spark, middle):
    from eventide.llm.queries import QUERIES

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(os.path.join(middle, "labels.parquet")).to_pylist()}
    scores = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op1_toxicity"](spark, middle).collect() if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for s, y in scores if y == v] for v in (1, 0))
    assert bad and good
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.9


def test_scores_are_those_that_were_trained(spark, edge):
    """The query against the likelihood written out sentence by sentence, with the weights that the query's fit gives."""
    from eventide.llm.common import table
    from eventide.llm.queries import op1_toxicity

    model = toxicity.train(table(spark, edge, "documents"), table(spark, edge, "labels"))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    texts = Counter((r["doc_id"], r["text"] or "") for r in table(spark, edge, "documents").select("doc_id", "text").collect())
    want = Counter()
    for (i, text), times in texts.items():
        sentences = [[w for w in re.split(rb"[^a-z0-9\x80-\xff]+", s) if w] for s in re.split(rb"[.!?\n\x01]", text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))]
        n = sum(bool(s) for s in sentences)
        bias, clean = model.bias - math.log1p(n / toxicity.LONG), 1 - logistic(model.leak + model.length * n / (n + toxicity.SHORT))
        for s in sentences:
            clean *= (1 - logistic(bias + sum(model.weights.get(f, 0.0) for w in s for f in toxicity.features(w)))) / (1 - logistic(bias))
        want[i, round(1 - clean, 6), int(1 - clean >= 0.3)] += times
    assert Counter((r["doc_id"], round(r["score"], 6), r["predicted"]) for r in op1_toxicity(spark, edge).collect()) == want


def test_length_alone_is_not_toxic(middle):
    """Texts of megabytes and of nothing but stops, by a model of the middle table's labels."""
    text = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(os.path.join(middle, "documents.parquet")).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(os.path.join(middle, "labels.parquet")).to_pylist() if r["toxic"] is not None and r["doc_id"] in text}
    model = toxicity.fit([text[i] for i in labels], np.array(list(labels.values())))
    score = lambda t: model.noisy_or(*model.sentences(t))
    toxic = max((text[i] for i in labels if labels[i]), key=score)
    clean = b"\n".join(t for i, t in text.items() if score(t) < 0.05 and not labels.get(i))
    clean *= 4_000_000 // len(clean) + 1
    assert score(toxic) > 0.3
    for t in (b"", b". " * 20_000, b"!" * 20_000, b"\n" * 100_000, clean):
        assert score(t) < 0.3
    assert score(clean + b"\n" + toxic) > 0.3 and score(b". " * 20_000 + toxic) > 0.3


@given(st.lists(st.integers(0, 49_407), max_size=300))
@settings(max_examples=60, deadline=None)
def test_token_blocks_round_trip(ids):
    coded = tokenids.encode_ids(np.array(ids, np.int64))
    assert tokenids.decode_ids(coded, len(ids)).tolist() == ids


@pytest.mark.parametrize("name, parts", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_librarys_whatever_the_tokenizer(spark, small, name, parts):
    """A tokenizer that doesn't work word by word gets whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    assert tokenids.Encoder(path).in_parts == parts
    texts = ["", "It's 3.5 o'clock,\n\n  they'LL say", "naïve ÇA İstanbul ﬁ 漢字 🙂", "tab\tand\x00nul <|endoftext|> x<|endoftext|>y", "a  b   c\u2003d\u0085e", "e\u0301 \u212b ß ẞ Σ. ΑΣ,"]
    texts += [t or "" for t in pq.read_table(os.path.join(small, "documents.parquet"), columns=["text"]).column(0).to_pylist()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in tokenids.token_ids(docs, path, 1).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]


def test_rows_of_one_id_are_dealt_to_several_shards(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    out = tokenids.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 1).orderBy("start").collect()
    ids = [r["doc_id"] for r in out]
    assert len(out) == 4000 and ids[:3600] == [None] * 3600 and ids[3600:] == sorted(ids[3600:])
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))


def test_ppm_probabilities_add_up():
    texts = [b"the cat sat on the mat", b"the cat ate", b"a mat and a hat", b"the hat"]
    order = 3
    keys, counts = np.unique(ppm.packed_grams(texts, order)[0], return_counts=True)
    model = ppm.Model(keys, counts, order)
    for context in (b"the", b"he ", b"zzz", b" ca", b"at\x20"):
        head = int.from_bytes(context, "big") << 8
        got = 10 ** model.scores(np.array([head + b for b in range(256)], np.uint64))
        assert 1 - 3 / 257 <= got.sum() <= 1 + 1e-9
    seen, unseen = model.text_scores([b"the cat", b"xqj zzk"])
    assert seen > unseen


def test_ppm_scores_by_hand():
    """Each byte by its contexts' own dictionaries: longest first, what a context has seen excluded from all shorter ones."""
    order, train = 3, [b"the cat sat on the mat", b"the cat ate the hat", b"a mat and a hat", b"no cats"]
    keys, counts = np.unique(ppm.packed_grams(train, order)[0], return_counts=True)
    model = ppm.Model(keys, counts, order)
    seen: dict[bytes, Counter] = {}
    for t in train:
        padded = ppm.START * order + t + ppm.END
        for i in range(order, len(padded)):
            for d in range(order + 1):
                seen.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    for text in (b"the cat", b"the hats on a xyz", b"", b"qqq the", "\u00e9 mat".encode()):
        padded, want = ppm.START * order + text + ppm.END, 0.0
        for i in range(order, len(padded)):
            excluded: set[int] = set()
            for d in range(order, -1, -1):
                left = {b: n for b, n in seen.get(padded[i - d : i], {}).items() if b not in excluded}
                if left:
                    total, escape = sum(left.values()), model.escapes[order - d].of(np.array([sum(left.values())]), np.array([len(left)]))[0]
                    if padded[i] in left:
                        want += math.log10((1 - escape) * (left[padded[i]] - 0.5) / (total - 0.5 * len(left)))
                        break
                    want += math.log10(escape)
                    excluded |= set(left)
            else:
                want -= math.log10(ppm.SYMBOLS - len(seen[b""]))
        assert model.text_scores([text])[0] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("order, size", [(6, 2000), (6, 20), (2, 20), (1, 20)])
def test_ppm_keeps_its_order_at_every_size(spark, order, size):
    """The larger table has over 2.5 million distinct grams of seven bytes; scores are those of a trie held in one piece."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    docs = [(i, rng.choice(letters, 2600).tobytes().decode() if i % 4 else "all of these texts start alike") for i in range(size)] + [(size, "\u00e9t\u00e9"), (size + 1, None)]
    train = [b" ".join(ppm.tokens((t or "").encode())) for i, t in docs if not ppm.held_out(i, 7, 2)]
    keys, counts = np.unique(ppm.packed_grams(train, order)[0], return_counts=True)
    assert (len(keys) > 2_500_000) == (size == 2000)
    want = dict(zip([i for i, _ in docs], ppm.Model(keys, counts, order).text_scores([b" ".join(ppm.tokens((t or "").encode())) for _, t in docs])))
    out = ppm.language_model_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), order=order).collect()
    assert {r["doc_id"] for r in out} == set(want) and len(out) == len(want)
    assert all(abs(r["score"] - want[r["doc_id"]]) <= 1e-5 * abs(want[r["doc_id"]]) + 1e-9 for r in out)


def test_ppm_counts_a_batch_in_parts(monkeypatch):
    """The memory for a batch's grams goes by the part; the counts are those of all texts at once."""
    r = np.random.default_rng(7)
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 3, 5)) for _ in range(1_000)) for _ in range(300)]  # 1.8 MB
    batch = pa.RecordBatch.from_arrays([pa.array([7 * i for i in range(300)]), pa.array(texts)], names=["doc_id", "text"])

    def counted(part: int) -> tuple[dict, int]:
        monkeypatch.setattr(ppm, "PART_BYTES", part)
        tracemalloc.start()
        rows = [row for b in ppm._statistics(6, 3, 7, 2, 32 << 20)(iter([batch])) for row in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return {(x["kind"], x["share"]): (x["keys"], x["counts"], x["n"]) for x in rows}, peak

    (whole, much), (parts, less) = counted(1 << 40), counted(1 << 17)
    assert parts == whole and less < much / 2
    assert sum(ppm.unpacked(c, n, "<i8").sum() for (kind, _), (_, c, n) in whole.items() if kind == "gram") == sum(len(t) + 1 for i, t in enumerate(texts) if not ppm.held_out(7 * i, 7, 2))


@pytest.mark.parametrize("order", [6, 7])
def test_ppm_scores_texts_of_a_chunk_together(monkeypatch, order):
    """Short texts aren't sorted one by one; each one's sum and missed grams are those that it has alone."""
    r = np.random.default_rng(11)
    texts = ["".join("ab c\u00e9"[c] for c in r.integers(0, 5, r.integers(0, 40))) for _ in range(1_000)] + ["", "d" * 600_000, "abc"]
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    chunk = pa.Table.from_batches([batch]).append_column("chunk", pa.array([0] * len(ids), pa.int32()))
    held = [(x["kind"], x["keys"], x["counts"]) for s in ppm._merged(ppm._statistics(order, 1, 7, 2, 32 << 20)(iter([batch]))) for x in s.to_pylist()]
    calls, counted = [], ppm.counted
    monkeypatch.setattr(ppm, "counted", lambda keys: calls.append(len(keys)) or counted(keys))
    asked = [(0, ppm.WORDS if kind == "word" else ppm.GRAMS, keys, counts, None, None) for kind, keys, counts in held] + [tuple(x.values()) for x in ppm._requests(order, 1)(chunk).to_pylist()]
    answers = pa.Table.from_batches(ppm._answers([pa.RecordBatch.from_pylist([dict(zip("scabnm", x)) for x in asked])]))
    (grams, counts), = [(np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")) for kind, k, c in held if kind == "gram"]
    model = ppm.Model(grams, counts, order)
    out = ppm._score(order, 1, model.escapes[0], 7, 2)(chunk, answers).to_pylist()
    assert [x["doc_id"] for x in out] == ids and len(calls) < 20
    for x, text in zip(out, texts):
        keys, times = np.unique(ppm.packed_grams([ppm.normal(text.encode())], order)[0], return_counts=True)
        logs = model.top.get(keys).astype(float)
        gone = np.isnan(logs)
        assert x["score"] == pytest.approx((logs[~gone] * times[~gone]).sum(), rel=1e-5)
        assert x["missed"] == keys[gone].tobytes() and x["times"] == times[gone].tobytes() and x["n_tokens"] == len(text.split()) + 1
    assert any(x["missed"] for x in out)


def test_ppm_grams_of_many_chunks_go_down_together(monkeypatch):
    """Few missed grams of each of many chunks are looked up at once, and what goes on is in a row for each share, not each chunk."""
    keys, counts = np.unique(ppm.packed_grams([b"the cat sat", b"a mat and a hat"], 3)[0], return_counts=True)
    model = ppm.Model(keys, counts, 3)
    asked = [int.from_bytes(b, "big") for b in (b"zcat", b"the ", b"qqqq", b" cab")]
    rows = [{"chunk": i, "missed": np.array([asked[i % 4], asked[3]], "<u8").tobytes()} for i in range(50)]
    held = (0, ppm.GRAMS, None, keys.astype("<u8").tobytes(), counts.astype("<i8").tobytes(), None, None)
    calls, descend = [], ppm.descend
    monkeypatch.setattr(ppm, "descend", lambda *args: calls.append(1) or descend(*args))
    going = [tuple(r.values()) for b in ppm._missed(3, 1)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    made = [r for b in ppm._go_down(3, 1, model.escapes[0])([ppm._down_rows([held, *going])]) for r in b.to_pylist()]
    rest = [r for r in made if r["share"] != ppm.DONE]
    assert len(calls) == 1 and len(going) == len(rest) == 1
    got = {}
    for r in made:
        own = np.frombuffer(r["keys"], "<u8")
        of = np.frombuffer(r["chunks"], "<i4") if r["share"] != ppm.DONE else np.full(len(own), r["chunk"])
        got |= {(int(c), int(k)): (g, r["share"] == ppm.DONE) for c, k, g in zip(of, own, np.frombuffer(r["gain"], "<f8"))}
    assert set(got) == {(i, k) for i in range(50) for k in (asked[i % 4], asked[3])}
    for (_, k), (gain, done) in got.items():
        want, hit, *_ = descend(model.levels[0], model.escapes[0], 3, np.array([k], np.uint64), np.array([np.nan]), np.array([np.nan]))
        assert gain == want[0] and done == hit[0]


def test_ppm_without_training_texts(spark):
    ids = [i for i in range(40) if ppm.held_out(i, 7, 2)]
    out = ppm.language_model_scores(spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string")).collect()
    assert len(out) == len(ids) and all(abs(r["score"] + 3 * np.log10(257)) < 1e-9 for r in out)


def test_pieces_are_drawn_by_weight():
    from eventide.llm.pieces import Lattices, PieceModel

    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    text = " theme"
    found: dict[tuple, float] = {}

    def ways(at: int, ids: tuple, log: float):
        if at == len(text):
            found[ids] = math.exp(log)
        for end in range(at + 1, len(text) + 1):
            i = pieces.get(text[at:end])
            if i is not None:
                ways(end, (*ids, i), log + model.weights[i])

    pieces = {b.decode(): i for i, b in enumerate(model.bytes) if b and b.isascii() and i not in set(model.byte_ids.tolist())}
    ways(0, (), 0.0)
    z = sum(found.values())
    n = 20_000
    drawn = Lattices(model).sample([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    tally: dict[tuple, int] = {}
    for ids, log in drawn:
        key = tuple(ids.tolist())
        assert log == pytest.approx(math.log(found[key] / z), abs=1e-5)
        tally[key] = tally.get(key, 0) + 1
    for key, p in found.items():
        p /= z
        assert abs(tally.get(key, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def whole_lattice(model, text: str) -> tuple[dict, float, list[float], list[float]]:
    """By plain sums over the whole text: pieces, log of all weights, and the forward and backward logs of each place."""
    pieces = {b.decode(): i for i, b in enumerate(model.bytes) if b and b.isascii() and i not in set(model.byte_ids.tolist())}
    fore, back = [0.0], [0.0]
    for e in range(1, len(text) + 1):
        fore.append(np.logaddexp.reduce([fore[a] + model.weights[pieces[text[a:e]]] for a in range(max(0, e - 16), e) if text[a:e] in pieces]))
    for a in range(len(text) - 1, -1, -1):
        back.insert(0, np.logaddexp.reduce([back[e - a - 1] + model.weights[pieces[text[a:e]]] for e in range(a + 1, min(len(text), a + 16) + 1) if text[a:e] in pieces]))
    return pieces, fore[-1], fore, back


@pytest.mark.parametrize("long, n", [(4096, 3000), (64, 200)])
def test_pieces_of_long_texts_are_drawn_from_the_whole_lattice(long, n, monkeypatch):
    """Runs of spaces, words of several hundred letters: probabilities are those of the lattice that nothing cuts."""
    from eventide.llm import pieces as own

    monkeypatch.setattr(own, "LONG", long)
    model = own.PieceModel(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    r = random.Random(11)
    text = "in   the" + " " * 21 + "".join(r.choice("theandersonicaling") for _ in range(300)) + "  of  the" + " " * 5
    pieces, z, fore, back = whole_lattice(model, text)
    assert max(map(len, model.units(text))) > 64 and "".join(model.units(text)) == text
    drawn = own.Lattices(model).sample([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(104_729))
    times: dict[tuple[int, int], int] = {}
    for ids, log in drawn:
        assert log == pytest.approx(model.weights[ids].sum() - z, abs=1e-3)
        at = 0
        for i in ids.tolist():
            end = at + len(model.bytes[i])
            times[at, end] = times.get((at, end), 0) + 1
            at = end
    checked = 0
    for a in range(len(text)):
        for e in range(a + 1, min(len(text), a + 16) + 1):
            if text[a:e] in pieces:
                p = math.exp(fore[a] + model.weights[pieces[text[a:e]]] + back[e] - z)
                assert abs(times.get((a, e), 0) / n - p) < 5.5 * math.sqrt(p * (1 - p) / n) + 2e-3
                checked += " " in text[a + 1 : e]
    assert checked > 20


@given(st.text(max_size=80), st.integers(0, 2**63))
@settings(max_examples=80, deadline=None)
def test_pieces_are_lossless(text, seed):
    from eventide.llm.pieces import _lattices

    own = _lattices(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    text = text.encode("utf-8", "ignore").decode()
    ((ids, _),) = own.sample([text], np.array([seed], np.uint64))
    assert own.model.decode(ids).decode() == text


def test_field_decodes_and_sums_like_all_labellings():
    r = np.random.default_rng(3)
    for n in (1, 2, 5):
        e, step, start = r.normal(size=n), r.normal(size=(2, 2)), r.normal(size=2)
        value = {y: start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        field = mainhtml.Field({}, tuple(map(tuple, step.tolist())), tuple(start.tolist()))
        assert tuple(map(int, field.decode(e.tolist()))) == max(value, key=value.get)
        log_z, main, pairs = mainhtml.log_partition(e[None], np.array([n]), step, start)
        z = sum(map(math.exp, value.values()))
        assert log_z[0] == pytest.approx(math.log(z))
        for i in range(n):
            assert main[0, i] == pytest.approx(sum(math.exp(v) for y, v in value.items() if y[i]) / z)
        assert pairs.sum() == pytest.approx(n - 1)


def test_field_generalises_to_other_layouts():
    field = mainhtml.fit(labelled_pages(300, 1))
    right = total = 0
    for page in labelled_pages(150, 77):
        blocks = mainhtml.leaf_blocks(page, mainhtml.Node("", None, ""))
        right += sum(y == b.node.label for y, b in zip(field.decode(field.emissions(blocks)), blocks))
        total += len(blocks)
    assert right / total > 0.98


def test_main_text_of_layouts_that_were_not_trained_on():
    """By words: at least 0.9 of what is given back is main text, and of the main text at least 0.9 is given back."""
    from tests.llm.layouts import LAYOUTS, pages

    field = mainhtml.fit([*labelled_pages(600, 6), *bare_pages(80, 7)])
    both, given, wanted = Counter(), Counter(), Counter()
    for name, page, main in pages():
        got, want = Counter(field.extract(page, mainhtml.Node("", None, "")).split()), Counter(main.split())
        both[name] += (got & want).total()
        given[name] += got.total()
        wanted[name] += want.total()
    assert both.total() / given.total() > 0.95 and both.total() / wanted.total() > 0.95
    for layout in LAYOUTS:
        name = layout.__name__
        assert both[name] / given[name] > 0.85 and both[name] / wanted[name] > 0.9, name


def test_text_that_is_shown_is_looked_at():
    page = "<body><article><p>one <math><mi>x</mi></math> two</p><object><p>three</p></object><svg><p>four</p><noscript><p>five</p></noscript></article>"
    assert [b.text for b in mainhtml.leaf_blocks(page, mainhtml.Node("", None, ""))] == ["one x two", "three", "four", "five"]
    assert [b.text for b in mainhtml.leaf_blocks("<p>a</p><script>never ends <p>b", mainhtml.Node("", None, ""))] == ["a"]


def test_leaf_blocks():
    page = "<html><head><title>t &amp; u</title></head><body><nav><a href='a>b'>menu</a></nav><div class=x>one<b>two</b> <br>\n three<p>four &lt;x<p>five<!-- no --></div><script>'<p>'</script>tail</body>"
    blocks = mainhtml.leaf_blocks(page, mainhtml.Node("", None, ""))
    assert [b.text for b in blocks] == ["menu", "onetwo three", "four <x", "five", "tail"]
    assert {"t:nav", "in:nav"} & blocks[0].node.features and "c:x" in blocks[3].node.features


@given(st.binary(min_size=1, max_size=200), st.integers(1, 8), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_winnowing_keeps_the_rightmost_least_of_each_window(text, k, window):
    found = winnowing.winnow(text, k, window)
    data = np.frombuffer(text, np.uint8)
    hashes = [int(h) for h in winnowing.gram_hashes(data, min(k, len(data))) >> np.uint64(32)]
    size = min(window, len(hashes))
    want = sorted({max(range(i, i + size), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - size + 1)})
    assert found.positions.tolist() == want and found.hashes.tolist() == [hashes[i] for i in want]
    back = winnowing.decode(winnowing.encode(found))
    assert back.positions.tolist() == want


def test_winnowing_guarantees_long_matches():
    r = random.Random(5)
    for _ in range(50):
        shared = bytes(r.randrange(97, 123) for _ in range(35))
        a, b = (bytes(r.randrange(97, 123) for _ in range(r.randrange(0, 90))) + shared + bytes(r.randrange(97, 123) for _ in range(40)) for _ in range(2))
        assert set(winnowing.winnow(a, 12, 24).hashes.tolist()) & set(winnowing.winnow(b, 12, 24).hashes.tolist())


@given(st.lists(st.integers(1, 4), max_size=120), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_backward_search_finds_and_locates_all_occurrences(seq, phrases):
    from eventide.llm import fmindex

    ends = np.array([*seq, 0])
    assert fmindex.suffix_array(ends).tolist() == sorted(range(len(ends)), key=lambda i: ends[i:].tolist())
    index = fmindex.FMIndex.of(np.array(seq, np.int64), 4, step=3)
    for p in phrases:
        which, low, high = index.search(np.array([p]))
        at = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
        assert at == [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]


def test_index_is_the_same_after_it_was_written():
    from eventide.llm import fmindex

    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(60))).encode() for _ in range(50)]
    texts += texts[:5] + [b""]
    shard = fmindex.Shard.build(texts)
    phrases = fmindex.Phrases.of([("1", b"a b a"), ("2", b"c c d a b b"), ("3", b"nowhere to find"), ("4", b"")], 4)
    found = shard.find(phrases)
    assert fmindex.Shard.from_bytes(shard.to_bytes()).find(phrases) == found
    for text, items in zip(texts, found.items):
        own = b" " + text + b" "
        assert items == [i for i, ws in (("1", [b"a b a"]), ("2", [b"c c d a", b"c d a b", b"d a b b"])) if any(b" " + w + b" " in own for w in ws)]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    from eventide.llm.pii import pseudonymise

    texts = ["pay 4111 1111 1111 1111 now", "again 4111 1111 1111 1111!", "not a card 4111 1111 1111 1112", "mail ann.lee@example.com or bob@example.com", "IBAN DE89370400440532013000 ok", "born 1984-02-29, seen 3.4.2020", "ip 10.0.0.7", "call +49 30 1234567", "id 123-45-6789", "no such day 2023-02-30", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonymise(docs, "k").collect()}
    a, b = (re.search(r"\d{4} \d{4} \d{4} \d{4}", out[i]["text"])[0] for i in (0, 1))
    assert a == b != "4111 1111 1111 1111" and luhn(a.replace(" ", ""))
    for i in (2, 9, 10, 11):
        assert out[i]["text"] == texts[i] and not out[i]["pii_kinds"]
    assert re.fullmatch(r"mail [a-z]{3}\.[a-z]{3}@example\.com or [a-z]{3}@example\.com", out[3]["text"]) and out[3]["pii_kinds"] == ["email", "email"]
    iban = re.search(r"DE\d{20}", out[4]["text"])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert re.fullmatch(r"born \d{4}-\d{2}-\d{2}, seen \d{1,2}\.\d{1,2}\.\d{4}", out[5]["text"]) and out[5]["pii_kinds"] == ["date", "date"]
    assert all(int(x) < 256 for x in re.search(r"ip (.*)", out[6]["text"])[1].split("."))
    assert re.fullmatch(r"call \+49 \d{2} \d{7}", out[7]["text"]) and re.fullmatch(r"id \d{3}-\d{2}-\d{4}", out[8]["text"])


def test_pseudonyms_of_numbers_side_by_side(spark):
    from eventide.llm.pii import pseudonymise

    def luhn(t):
        d = [int(c) for c in t if c.isdigit()][::-1]
        return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])

    texts = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "room 12 4111 1111 1111 1111.", "4111-1111-1111-1111 7", "4111 1111 1111 1111", "pay DE89 3704 0044 0532 0130 00 now", "DE89370400440532013000", "BE68 5390 0754 7034 4111 1111 1111 1111", "DE88 3704 0044 0532 0130 00 stays"]
    out = [r["text"] for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for i, form in enumerate([r"(\d{4} \d{4} \d{4} \d{4}) 12/27", r"(\d{16}) 123", r"room 12 (\d{4} \d{4} \d{4} \d{4})\.", r"(\d{4}-\d{4}-\d{4}-\d{4}) 7", r"(\d{4} \d{4} \d{4} \d{4})"]):
        card = re.fullmatch(form, out[i])[1]
        assert luhn(card) % 10 == 0 and re.sub(r"\D", "", card) != "4" + "1" * 15
        assert re.sub(r"\D", "", card) == re.sub(r"\D", "", out[4])
    assert re.fullmatch(r"pay DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d now", out[5]) and out[5].replace(" ", "") == "pay" + out[6] + "now" and out[6] != texts[6]
    assert out[7].startswith("BE") and out[7][:19] != texts[7][:19] and out[7][20:] == out[4]
    assert out[8] == texts[8]


def test_digit_permutation_is_one_to_one(spark):
    from eventide.llm.pii import permute_digits

    found = spark.range(1000).select(permute_digits("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p")).collect()
    assert len({r["p"] for r in found}) == 1000 and all(re.fullmatch(r"\d{3}", r["p"]) for r in found)
