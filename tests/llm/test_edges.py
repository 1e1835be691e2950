"""Nulls, empty tables, repeated rows, ties and clashing columns for the operators and stages."""

import hashlib
import math
import random
import zlib

import pytest

from scorenet.llm import chat_format, embedding_dedup, exact_dedup, hpylm, html_content, kn_quality, packing, piece_sampling, simhash_index, token_frames
from scorenet.storage import fresh_path

P = pytest.importorskip("public_tokenizers")
#: Extra columns bear the names of the operators' own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, key long, digest string, kept boolean, n int"
LONG = "word " * 20_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 1, 2, 3, "x", True, 4) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "one  two\tthree", "en"), (3, "one  two\tthree", "en"), (5, "one two three", None), (None, "alone here", "xx"), (7, LONG, "en")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_exact(spark, odd, none):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_batch(odd, exact_dedup.fresh_index(spark)).collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 3, True), (3, 3, 3, False), (5, 3, 3, False), (None, None, 1, True), (7, 7, 1, True)], key=str)
    assert exact_dedup.dedup_batch(none, exact_dedup.fresh_index(spark)).count() == 0
    left = exact_dedup.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 7]
    assert exact_dedup.stage(spark, none, "").count() == 0


def test_exact_keeps_index(spark, odd):
    index = exact_dedup.fresh_index(spark)
    exact_dedup.dedup_batch(odd, index).collect()
    again = exact_dedup.dedup_batch(odd.where("doc_id = 5"), index).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in again] == [(3, 4, False)]


def test_exact_batches(spark, odd):
    index = exact_dedup.fresh_index(spark)
    first = exact_dedup.dedup_batch(odd, index, batch="a").collect()
    # Run again after it broke off between append and result: the same rows.
    assert sorted(map(str, exact_dedup.dedup_batch(odd, index, batch="a").collect())) == sorted(map(str, first))
    assert not any(r.kept for r in exact_dedup.dedup_batch(odd, index).collect())
    one = odd.where("doc_id = 7")
    assert [r.kept for r in exact_dedup.dedup_batch(one, index).collect()] == [False]
    more = documents(spark, [(1, "quite new", "en"), (2, "alone  here", "en")])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup_batch(more, index).collect()) == [(1, 1, True), (2, None, False)]
    assert exact_dedup.DigestIndex(spark, index.path).buckets == index.buckets
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, index.buckets + 1)


def test_hpylm(odd, none):
    rows = hpylm.score(odd).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 4, 4, 4, 20_001]
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {zlib.crc32(b"") % 5 == 1}
    assert hpylm.score(none).count() == 0


def test_token_frames(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    at = token_frames.write_tokens(odd, fresh_path(spark, "tokens"), path, 1)
    rows = sorted(token_frames.read_tokens(spark, at).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 5, 7]
    assert [r.n_tokens for r in rows[1:3]] == [1, 1] and rows[3].ids == rows[4].ids
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert token_frames.read_tokens(spark, token_frames.write_tokens(none, fresh_path(spark, "tokens"), path, 1)).count() == 0


def test_damaged_frame_is_found():
    import io

    sink = io.BytesIO()
    out = token_frames.FrameWriter(sink, frame_tokens=4)
    for i in range(5):
        out.add(i, bytes([i] * 12))
    out.close()
    data = sink.getvalue()
    reader = token_frames.FrameReader(io.BytesIO(data))
    assert list(reader.read([3])) == [(3, bytes([3] * 12))]
    broken = bytearray(data)
    broken[int(reader.at[1]) + int(reader.sizes[1]) - 1] ^= 255
    with pytest.raises(Exception):  # noqa: B017 - of the decompressor or of the checksum
        list(token_frames.FrameReader(io.BytesIO(bytes(broken))).read())


def test_chat(spark):
    kinds = f"conv_id long, turn long, role string, parts {chat_format.PARTS}, _turn int, formatted string"
    part = ("image", None, "a.png", 57, 28, None, None)
    rows = [(1, 0, "user", [("text", "a<b\\l", None, None, None, None, None), part], 9, "z"), (1, 1, "assistant", None, 9, "z"), (1, 2, "assistant", [("text", "é😀</turn>\n", None, None, None, None, None)], 9, "z"), (None, None, None, None, 9, "z")]
    rows.append(rows[0])
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, kinds)).collect()}
    assert got.keys() == {1, None}
    text = got[1].formatted
    assert [text[s.start : s.end] for s in got[1].loss] == ["", "é😀\\l/turn>\n"]
    assert [(a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", 3), (2, "image", "a.png", 3)]
    assert got[None].formatted == "<turn>\n</turn>\n"
    assert chat_format.format_chats(spark.createDataFrame([], kinds)).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 1), (7, 1), (None, 1), (5, None), (2, 0)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        out = kn_quality.classify(odd, marks)
        assert out.columns == [*odd.columns, "_perplexity", "_steadied", "_threshold", "_keep"]
        rows = out.collect()
        assert len(rows) == 7
        assert all((r._perplexity is None and not r._keep) for r in rows if not r.text)
    assert {r._keep for r in rows if r.text} == {True}
    assert kn_quality.classify(none, labels).count() == 0


def test_pieces(odd, none):
    model = P.path("piece_bpe_32k.model")
    got = piece_sampling.encode(odd, model).collect()
    assert {r.doc_id: list(r.ids) for r in got if r.doc_id in (1, 2)} == {1: [], 2: []}
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    back = piece_sampling.decode(piece_sampling.encode(odd, model), model).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())
    assert piece_sampling.decode(piece_sampling.encode(none, model), model).count() == 0


def test_simhash(spark, odd, none):
    got = sorted(((r.doc_id, r.component_id) for r in simhash_index.simhash_classes(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (5, 3), (None, None), (7, 7)], key=str)
    assert simhash_index.simhash_classes(none).count() == 0
    left = simhash_index.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {None, 1, 3, 7}
    assert simhash_index.stage(spark, none, "").count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    kinds = "vec_id long, embedding array<float>, key long, vec string, n int"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (2, [2.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1e-30]), (12, [3.0, 0.0, 1.0, 1.0]), (13, [6.0, 0.0, 2.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], kinds)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.cosine_classes(frame).collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in range(4, 12)), (12, 1, 12, True), (13, 1, 12, False)])
    assert embedding_dedup.cosine_classes(frame.limit(0)).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, P.path("byte_bpe_50k.json"), 0).collect()
    assert sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)) == [(0, 1, 1)] * 2
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.doc_id == 7) == {r.doc_tokens for r in rows if r.doc_id == 7}.pop()
    assert packing.pack(none, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_packing_of_one_row_many_times(spark, odd):
    many = spark.range(3000).selectExpr("7L as doc_id", "'the same few words' as text")
    rows = packing.pack(many, P.path("byte_bpe_50k.json"), 0, group_docs=50).collect()
    assert sum(r.length for r in rows) == 3000 * rows[0].doc_tokens
    groups = {r.sequence_id >> 32 for r in rows}
    assert len(groups) > 40  # of sixty


def test_stages_keep_columns(spark, odd, none):
    """Stages that read a folder's labels, with extra columns named as their own."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(None, None, None), (-5, "", "en")])
    left = kn_quality.stage(spark, docs, sf)
    assert left.columns == docs.columns and 0 < left.count() < 62 and not {-5, None} & {r.doc_id for r in left.collect()}
    pieces = packing.stage(spark, odd, sf)
    assert {r.doc_id for r in pieces.collect()} == {None, 1, 2, 3, 5, 7} and packing.stage(spark, none, sf).count() == 0


def test_html(spark):
    long = "<article>" + "<p>a &amp; b</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p>x<b>y</b>"), (5, "w", long), (6, "w", "<nav>menu</nav>"), (7, "w", "<![x<!-- <a b='")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_content.extract(frame).collect()), key=str)
    want = "\n".join(["a & b"] * 20_000)
    assert [g for g in got if g[0] != 7] == sorted([(1, "", 0), (2, "", 0), (2, "", 0), (None, "xy", 2), (5, want, len(want)), (6, "", 0)], key=str)
    assert html_content.extract(frame.limit(0)).count() == 0


def test_html_takes_any_markup():
    rng = random.Random(3)
    bits = ["<", ">", "<!", "<![", "<!-", "-->", "]]>", "<!DOCTYPE", "<p", "</p", "<article>", "</article>", "<script>", "</script", "<a b='", '"', "&", "&#", "&#x110000;", "&#xD800;", "&nbsp;", "text ", "\n", "/>", "[", "<?", "<title>", "<textarea>", "\0", "é"]
    for _ in range(3000):
        html_content.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))).encode()


def test_digest_is_of_normalised_text(spark, odd):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.dedup_batch(odd, exact_dedup.fresh_index(spark)).collect()}
    assert got[3] == hashlib.sha256(b"one two three").hexdigest() and got[1] == hashlib.sha256(b"").hexdigest()
