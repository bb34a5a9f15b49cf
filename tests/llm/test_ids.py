"""Ids that are texts, with colons, spaces and words that look like nothing."""

import tokenizers

from curatrix.llm import packing, warc


def test_archives_give_back_text_ids(spark):
    ids = ["a:1", "b:none", "none", "1", "x y>\r\n%", "é", None]
    pages = spark.createDataFrame([(i, f"http://h/{k}", "same " * 40 if k % 2 else f"page {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert set(got) == set(ids) and got["1"] == ("response", None) and got["b:none"] == got["é"] == ("revisit", "1")


def test_pieces_of_text_ids_equal_the_tokenizer(spark, sf_dir):
    """All columns that the tokenizer tells, over a whole table."""
    import struct
    import zlib

    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat('d:', doc_id) AS doc_id", "text").union(spark.createDataFrame([("none", None), (None, "")], "doc_id string, text string"))
    want = set()
    for doc, text in docs.collect():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want |= {(doc, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {tuple(r)[:5] for r in packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32").collect()} == want
