import pyarrow as pa
import pyarrow.parquet as pq

import sav_queries


def test_texts_are_read_whole(spark, tmp_path):
    texts = ["é " * 40_000 + "end", "a" * 31_998 + "  é" + " x" * 20_000, "€" * 33_000, "y" * 3_999 + "   z" * 3_000 + "  ", "", "|", "k" * 32_000, "Ω and œ"]
    pq.write_table(pa.table({"doc_id": range(8), "text": texts, "n_chars": [len(t) for t in texts]}), f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_chars) for r in sav_queries.QUERIES["vls_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: (t.rstrip(" "), len(t)) for i, t in enumerate(texts)}
    latin = {r.doc_id: r.text for r in sav_queries.QUERIES["charset_1252"](spark, str(tmp_path)).collect()}
    assert latin == {i: t.encode("cp1252", "ignore").decode("cp1252").rstrip(" ") for i, t in enumerate(texts)}
