import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TABLES = ("documents", "benchmark", "labels", "pages", "embeddings")
#: Names that operators use for columns of their own.
CLASHING = ("fp", "node", "component", "group", "chunk", "share", "part", "score", "held_out", "text_hash", "kept", "spans", "items", "pii_kinds", "_id", "n")
LONG = "word " * 40_000 + "tail of a very long text"
ODD = [None, "", " ", "\n\n", "x", "a b", "a b c", "A B C", LONG, LONG, "▁ piece", "tab\tand\x00null", "naïve ÇA ﬁ 漢字 🙂" * 3, "<|endoftext|> plain", "same text here for all of us", "same text here for all of us"]


def _edge(table: str, rows: pa.Table, documents: pa.Table, benchmark: pa.Table) -> pa.Table:
    """The small table with odd rows after it: nulls in any column, repeated rows, ties, extra columns."""
    if table == "documents":
        item = benchmark.column("text")[0].as_py()
        texts = [*ODD, item, "before " + item + " after", documents.column("text")[3].as_py(), "no id", None]
        ids = [*range(10_000, 10_000 + len(texts) - 2), None, None]
        ids[6] = ids[7] = 10_006  # one id, two texts that differ in case
        own = {"doc_id": ids, "text": texts, "lang": [None] * len(ids), "source": ["src0"] * len(ids), "n_chars": [None] * len(ids)}
        rows = pa.concat_tables([rows, pa.table(own, schema=rows.schema), rows.slice(5, 2)])
        for name in CLASHING:
            rows = rows.append_column(name, pa.array(["clash"] * rows.num_rows))
    elif table == "benchmark":
        rows = pa.concat_tables([rows, pa.table({"item_id": [None, 9_001, 9_002, 9_003], "text": ["null id", None, "", "same text here"]}, schema=rows.schema), rows.slice(0, 1)])
    elif table == "labels":
        rows = pa.concat_tables([rows, pa.table({"doc_id": [None, 1, 2], "quality": [1, None, 1], "toxic": [1, None, None]}, schema=rows.schema), rows.slice(0, 2)])
    elif table == "embeddings":
        width = len(rows.column("embedding")[0])
        vectors = [None, [], [None] * width, [float("nan")] * width, [1.0] * (width - 1), rows.column("embedding")[3].as_py()]
        rows = pa.concat_tables([rows, pa.table({"vec_id": [*range(9_000, 9_005), None], "embedding": vectors, "label": [None] * 6}, schema=rows.schema), rows.slice(0, 2)])
        rows = rows.append_column("component", pa.array(["clash"] * rows.num_rows))
    elif table == "pages":
        html = [None, "", "plain text only", "<p>unclosed <b>tags", "<article><p>One &amp; two<p>three</article><footer>&copy; me</footer>", "<script>if (a < b) {</script>", "< 3 <!-- never ends", "<article><p>" + LONG + "</article>"]
        rows = pa.concat_tables([rows, pa.table({"page_id": [*range(9_000, 9_007), None], "url": [None] * 8, "html": html}, schema=rows.schema), rows.slice(0, 2)])
        rows = rows.append_column("text", pa.array(["clash"] * rows.num_rows))
    return rows


@pytest.fixture(scope="session")
def edge(small, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("edge"))
    read = {t: pq.read_table(os.path.join(small, f"{t}.parquet")) for t in TABLES}
    for t in TABLES:
        pq.write_table(_edge(t, read[t], read["documents"], read["benchmark"]), os.path.join(out, f"{t}.parquet"), row_group_size=50)
    return out


@pytest.fixture(scope="session")
def empty(small, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        pq.write_table(pq.read_table(os.path.join(small, f"{t}.parquet")).slice(0, 0), os.path.join(out, f"{t}.parquet"))
    return out


@pytest.fixture(scope="session")
def documents(edge):
    """(doc_id, text) of the edge table, null texts as empty."""
    own = pq.read_table(os.path.join(edge, "documents.parquet"), columns=["doc_id", "text"]).to_pydict()
    return [(d, t or "") for d, t in zip(own["doc_id"], own["text"])]
