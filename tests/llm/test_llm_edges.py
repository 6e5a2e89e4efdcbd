"""Nulls, empty tables, ties, repeated rows, clashing names and hot groups for every operator."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import archive, chat, fertility, lines, mixing, packing, quality, repeats, search, shingles
from placemap.sources.storage import new_path
from conftest import SMALL
from test_llm_queries import check_pieces, shingle_groups, windows_removed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def docs(spark, texts, **extra):
    """Rows from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts], DOCS)


def collected(frame):
    return [r.asDict() for r in frame.collect()]


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "no id here, but some words and a line"), (5, "ünï\n日本語 text\r\n"), (5, "the same id again"), (7, LONG)]


# quality

LABELS = "doc_id long, quality int, toxic int"


def test_quality_edges(spark):
    table = docs(spark, ODD).withColumn("score", F.lit("clash")).withColumn("features", F.lit(1))
    none = spark.createDataFrame([], LABELS)
    rows = collected(quality.score_quality(table, none))
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    own = next(i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1)
    one = spark.createDataFrame([(own, 1, 0), (own, 1, 0), (None, 0, 0), (7, None, 0), (5, 3, 0)], LABELS)
    assert all(r["score"] > 0.5 for r in collected(quality.score_quality(table, one)))
    assert quality.score_quality(docs(spark, []), none).count() == 0
    kept = quality.keep_good(table, one)
    assert kept.columns == table.columns and kept.count() == len(ODD)


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in model.pairs
    total = model.base + sum(t[b] for t, b in zip(model.singles, model.bins(x[:1])[0]))
    total += sum(t[tuple(model.bins(x[:1])[0][list(k)])] for k, t in model.pairs.items())
    assert total == pytest.approx(model.log_odds(x[:1])[0])


# lines


def test_line_dedup_edges(spark):
    line = "A shared line of more than twenty"
    texts = [(i, f"{line}\nown {i}") for i in range(1, 4)] + [(3, f"  {line.upper()}\t"), (None, line), (9, None), (10, f"{line}\r"), (11, "short\nshort")]
    table = docs(spark, texts).withColumn("n_lines", F.lit("x")).withColumn("keeper", F.lit(0)).withColumn("digest", F.lit(0))
    out = lines.dedup_lines(table)
    assert out.columns == [c for c in table.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in collected(out))
    assert got == Counter([
        (1, "own 1", 2, 1), (2, "own 2", 2, 1), (3, "own 3", 2, 1), (3, "", 1, 1), (None, "", 1, 1), (9, "", 1, 0), (10, f"{line}\r", 1, 0), (11, "short\nshort", 2, 0),
    ])
    two = docs(spark, [(1, line), (2, line), (2, line), (None, line)])
    assert all(r["n_dropped"] == 0 for r in collected(lines.dedup_lines(two)))
    unicode_19 = docs(spark, [(i, "é" * 19) for i in range(5)] + [(i, "é" * 20) for i in range(5, 10)])
    assert sum(r["n_dropped"] for r in collected(lines.dedup_lines(unicode_19))) == 4
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_with_a_full_filter(spark):
    texts = [(i, "\n".join(f"line number {j} of the whole corpus" for j in range(i % 7, 40))) for i in range(60)]
    small = collected(lines.dedup_lines(docs(spark, texts), max_filter_bytes=1))
    assert sorted(map(str, small)) == sorted(map(str, collected(lines.dedup_lines(docs(spark, texts)))))


# top-k


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.25]), (2, [1.0, 0.5]), (3, [1.0, 0.5]), (3, [1.0, 0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (100, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    out = collected(search.top_k(table, F.col("vec_id") % 50 == 0, k=3))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    full = 256 * 256 + 128 * 128
    assert [got[0, r] for r in (1, 2, 3)] == [(2, full), (3, full), (3, full)]
    assert [got[50, r] for r in (1, 2, 3)] == [(0, 64 * 256), (2, 64 * 256), (3, 64 * 256)]
    assert [got[100, r] for r in (1, 2, 3)] == [(0, 0), (2, 0), (3, 0)]
    assert search.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [-1e30, 0.0]), (2, [1e30, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in sorted(collected(search.top_k(huge, F.col("vec_id") == 0)), key=lambda r: r["rank"])] == [(2, 2**63 - 1), (1, -(2**63))]


def test_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 40)).astype(np.float32)
    v[1000:1100] = v[0]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    ints = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    want = {}
    for q in range(0, 3000, 50):
        s = ints @ ints[q]
        want[q] = [(int(i), int(s[i])) for i in sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]]
    got = {}
    for r in sorted(collected(search.top_k(table, F.col("vec_id") % 50 == 0, k=5, block=300, query_block=16)), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


# near duplicates


def test_similar_groups_edges(spark):
    texts = [*ODD, (20, "a b c d e f"), (21, "A  B\tC d E F"), (22, "a b c"), (23, "A b\nc"), (24, "a b c d e f"), (24, "quite another text under one id")]
    table = docs(spark, texts).withColumn("node", F.lit("x")).withColumn("component_id", F.lit("x"))
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collected(shingles.similar_groups(table)))))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 6, None), (5, 1, 5), (5, 1, 5), (7, 1, 7), (20, 3, 20), (21, 3, 20), (22, 1, 22), (23, 1, 22), (24, 3, 20), (24, 3, 24)]
    assert got == sorted(map(str, want))
    assert shingles.similar_groups(docs(spark, [])).count() == 0
    assert sorted(r["doc_id"] for r in collected(shingles.keep_one(docs(spark, [(3, "a b c d e"), (1, "a b c d e"), (2, "x y z"), (4, "")])))) == [1, 2, 4]


@pytest.mark.parametrize("percent,words", [(85, 4), (80, 5), (50, 2)])
def test_similar_groups_in_a_crowd(spark, percent, words):
    """Many copies with a few words changed, hardly any two of them alike, beside documents that share a passage."""
    rng = random.Random(percent)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(60)}"
        texts.append((i, " ".join(copy)))
    for i in range(160, 260):
        own = [f"y{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        texts.append((i, " ".join(own[: len(own) // 2] + base[:50] + own[len(own) // 2 :])))
    texts += [(300 + i, t) for i, t in texts[:40]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(shingles.similar_groups(docs(spark, texts), words=words, percent=percent))}
    want = shingle_groups(dict(texts), words, percent)
    assert got == want
    assert len({g for _, g in want.values()}) < len(texts) - 40


@pytest.mark.parametrize("percent,words", [(85, 4), (80, 5)])
def test_similar_groups_of_short_texts(spark, percent, words):
    """Pairs with few shingles in common, 4 of 5 to 9 of 10, some of whose shingles other documents hold too."""
    rng = random.Random(words)
    texts = []
    for i in range(120):
        own = [f"p{i}w{k}" for k in range(words + 3 + i % 6)]
        texts += [(10 * i, " ".join(own)), (10 * i + 1, " ".join([*own, f"p{i}last"]))]
        for k in range(rng.randrange(4)):
            at = rng.randrange(len(own) - words + 1)
            texts.append((10 * i + 2 + k, " ".join([*own[at : at + words], *(f"p{i}x{k}y{j}" for j in range(20))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(shingles.similar_groups(docs(spark, texts), words=words, percent=percent))}
    want = shingle_groups(dict(texts), words, percent)
    assert got == want
    assert sum(i != g for i, (_, g) in want.items()) >= 60


def template_texts(n, words, vocabulary, seed=3):
    """Texts of one template that differ in three words; with a ``vocabulary`` those words come back in other texts."""
    draw = random.Random(seed)
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        for slot in (words // 6, words // 2, 5 * words // 6):
            text[slot] = f"own{i if vocabulary is None else draw.randrange(vocabulary)}at{slot}"
        yield i, " ".join(text)


@pytest.mark.parametrize(("words", "vocabulary"), [(85, None), (76, 6), (76, 40), (110, 5)])
def test_similar_groups_of_one_template(spark, monkeypatch, words, vocabulary):
    monkeypatch.setattr(shingles, "LONG_LIST", 16)  # lists are split by size band and dealt
    texts = list(template_texts(150, words, vocabulary))
    texts += [(1000 + i, t + " " + " ".join(f"tail{k}" for k in range(i % 23))) for i, t in texts[::3]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(shingles.similar_groups(docs(spark, texts), words=4, percent=85))}
    assert got == shingle_groups(dict(texts), 4, 85)


@pytest.mark.parametrize(("words", "vocabulary"), [(85, None), (76, 50)])
def test_lists_of_a_template_are_not_met(spark, words, vocabulary):
    def met(n):
        """Entries that inner entries meet, for texts whose own words come back in as many texts whatever n is."""
        sets = [shingles.shingles(t, 4) for _, t in template_texts(n, words, vocabulary and vocabulary * n // 100)]
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        rows = []
        for node, own in enumerate(sets):
            df = counts[np.searchsorted(tokens, own)]
            rank = sorted((int(c) << 48) | (int(h) >> 16) for h, c in zip(own, df) if c > 1)
            most = max(0, len(rank) - shingles.needed(len(own), 85) + shingles.MATCHES[-1])
            if len(rank) >= shingles.needed(len(own), 85):
                rows.append((node, len(own), len(rank), most, rank[: max(shingles.HEAD, most)], 2**63 - 1))
        postings = shingles._adaptive(spark.createDataFrame(rows, shingles.PROFILES), 85)
        lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.count_if("inner").alias("inner"))
        return lists.select(F.sum(F.col("k") * F.col("inner"))).first()[0]

    few, many = met(300), met(1200)
    assert many <= 5 * few


# chat

TEXTS = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "<", "|im_end|>", "", "\n\n  lead", "ends with <", "日本 <| 語", "\\", "<|", "a<\\", "tail\n"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, text) for i in range(6) for t, (role, text) in enumerate((("user", "system", "assistant")[(i + k) % 3], x) for k, x in enumerate(TEXTS[i:] + TEXTS[:i]))]
    rows += [(10, 0, "role\nwith <|im_end|> \\n", "x"), (10, 1, None, None), (None, 3, "assistant", "no id"), (11, None, "assistant", "null turn"), (11, 0, "user", "q"), (11, 0, "user", "q")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)).withColumn("formatted", F.lit(0))
    back = {r["conv_id"]: r for r in collected(chat.read_back(chat.format_chats(table)))}
    want = {}
    for i, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[1], r[2] or "", r[3] or ""))):
        want.setdefault(i, []).append((role or "", text or ""))
    assert {i: [(t["role"], t["text"]) for t in r["turns"]] for i, r in back.items()} == want
    assert {i: r["loss_text"] for i, r in back.items()} == {i: "".join(x for role, x in t if role == "assistant") for i, t in want.items()}
    assert all(len(r["token_ids"]) == len(r["loss_mask"]) for r in back.values())
    assert chat.format_chats(table.limit(0)).count() == 0


def test_no_masked_token_holds_foreign_bytes():
    """Texts that begin and end with line feeds, spaces and parts of control strings, next to each other."""
    from llm.encoding import vocabulary

    path, rng = vocabulary("byte_bpe_50k.tiktoken"), random.Random(2)
    ends = ["", "\n", "\n\n", " ", "\n\n\n ", "<", "|", "<|", "|>", "\\|", "<\\|", "<|im_sep|>", "日本", "é"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "assistant", "a\n<|im_sep|>"]), rng.choice(ends) + rng.choice(["x", "ok\n\nthen", ""]) + rng.choice(ends)) for _ in range(4)]
        text, spans = chat.render(turns)
        ids, mask, _ = chat.masked(text, spans, path)
        assert chat.parse(text) == turns
        assert chat.masked_texts(ids, mask, path) == [x for role, x in turns if role == "assistant" and x]


# archive


def test_archive(spark):
    big, small = "x" * 1200 + "é", "tiny"
    pages = [(1, "http://a", big), (2, "http://b\r\nWARC-Type: fake\u2028WARC-Refers-To: <urn:page:1> WARC-Payload-Digest: sha256:00", big), (9, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (9, "again", big), (None, "u", big), (-7, "u", "y" * 1000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("header", F.lit("x")).withColumn("digest", F.lit(0))
    folder = new_path(spark, "archive-test")
    archive.write_archive(table, folder)
    kind = lambda i, t: ("revisit", 9) if (t == big and i != 9) else ("response", None)
    rows = collected(archive.read_archive(spark, folder))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows)
    raw = [(i, t, (t or "").encode()) for i, _, t in pages]
    assert got == Counter((i, *kind(i, t), len(b), hashlib.sha1(b).hexdigest()) for i, t, b in raw)
    rows = collected(archive.read_records(archive.records(spark, folder)))
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], bytes(r["block"])) for r in rows)
    assert got == Counter((i, *kind(i, t), b"" if kind(i, t)[0] == "revisit" else b) for i, t, b in raw)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    for r in collected(archive.records(spark, folder)):
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and block[size:] == b"\r\n\r\n"
    cut = archive.records(spark, folder).withColumn("record", F.expr("substring(record, 1, octet_length(record) - 5)"))
    with pytest.raises(Exception, match="not a whole record"):
        archive.read_records(cut).collect()
    empty = new_path(spark, "archive-test")
    archive.write_archive(table.limit(0), empty)
    assert archive.read_archive(spark, empty).count() == 0


@pytest.mark.parametrize("harm", ["altered", "missing"])
def test_op6_stops_at_a_payload_that_is_not_proven(spark, monkeypatch, harm):
    from llm import queries

    def write(pages, folder):
        whole = new_path(spark, "archive-test")
        archive.write_archive(pages, whole)
        spark.read.parquet(f"{whole}/headers").write.parquet(f"{folder}/headers")
        payloads = spark.read.parquet(f"{whole}/payloads")
        payloads = payloads.withColumn("payload", F.lit(b"other")) if harm == "altered" else payloads.limit(0)
        payloads.write.parquet(f"{folder}/payloads")

    monkeypatch.setattr(queries, "write_archive", write)
    with pytest.raises(Exception, match="payload missing or altered"):
        queries.op6_content_addressed_warc(spark, SMALL).collect()


# fertility


def test_fertility_edges(spark):
    table = docs(spark, ODD).withColumn("lang", F.when(F.col("doc_id") > 3, "xx")).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("x"))
    rows = collected(fertility.judge(table))
    assert len(rows) == len(ODD)
    by_text = sorted((r["n_words"], r["base_failed"], r["kept"]) for r in rows)
    assert by_text[:3] == [(0, True, False)] * 3 and by_text[-1] == (40_000, True, False)
    assert fertility.judge(docs(spark, [])).count() == 0
    assert fertility.repeated_words(np.array([1] * 9)) == 9 and fertility.repeated_words(np.arange(30)) == 0


def test_fertility_rejects_what_the_vocabulary_splits_oddly(spark):
    rng = random.Random(3)
    known = "the people of this country have always been able to find some good water near their house and home".split()
    texts = [(i, " ".join(rng.choice(known) for _ in range(100))) for i in range(80)]
    texts += [(100, " ".join("".join(rng.choice("ꙮ҈ᚠ༄") for _ in range(6)) for _ in range(100)))]
    rows = {r["doc_id"]: r for r in collected(fertility.judge(docs(spark, texts)))}
    assert not rows[100]["kept"] and not rows[100]["base_failed"] and rows[100]["byte_share"] > 0.5
    assert all(rows[i]["kept"] for i in range(80) if not rows[i]["base_failed"])


def test_fertility_judges_small_groups_by_wider_ones(spark):
    rng = random.Random(5)
    known = "the people of this country have always been able to find some good water near their house and home".split()
    junk = lambda n: " ".join("".join(rng.choice("ꙮ҈ᚠ༄") for _ in range(6)) for _ in range(n))
    rows = [(i, " ".join(rng.choice(known) for _ in range(100)), "en") for i in range(80)]
    rows += [(100, junk(3000), "en"), (101, junk(100), "xx"), (102, junk(100), None), (103, " ".join(rng.choice(known) for _ in range(100)), "xy")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in collected(fertility.judge(table))}
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in (100, 101, 102))
    assert got[103]["kept"] and all(got[i]["kept"] for i in range(80) if not got[i]["base_failed"])


# mixing


@pytest.mark.parametrize("shares,rest", [({"a": 5, "b": 3, "c": 1}, 1), ({"a": 1}, 0), ({"a": 7, "b": 7, "c": 2, "d": 2, "e": 1}, 4)])
def test_mix_stays_within_one_block(spark, shares, rest):
    names = [*shares, *(["other"] if rest else [])]
    rows = [(i, None, None, names[i * i % len(names)] if i % 3 else "a", 0) for i in range(900)]
    out = sorted((r for r in collected(mixing.mix(spark.createDataFrame(rows, DOCS), shares, rest=rest, block_rows=4)) if r["in_mix"]), key=lambda r: r["position"])
    slots = sum(shares.values()) + rest
    weights = dict(zip(range(len(names)), [*shares.values(), *([rest] if rest else [])]))
    blocks = sorted({(r["slot"], r["lane"]) for r in out})
    assert [s for s, _ in blocks] == list(range(len(blocks)))
    placed = Counter()
    for t, (_, lane) in enumerate(blocks, 1):
        placed[lane] += 1
        assert all(abs(placed[i] - w * t / slots) < 1 for i, w in weights.items())


def test_mix_edges(spark):
    table = docs(spark, [*ODD, *ODD]).withColumn("slot", F.lit("x")).withColumn("Position", F.lit("x")).withColumn("share", F.lit("x")).withColumn("horizon", F.lit("x"))
    table = table.withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    out = mixing.mix(table, {"s1": 2, "gone": 3}, rest=2, block_rows=2)
    rows = collected(out)
    assert len(rows) == 2 * len(ODD) == len({r["position"] for r in rows})
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "share", "horizon", *mixing.ADDED]
    alone = collected(mixing.mix(table, {"s1": 1}, rest=0))
    assert len(alone) == len(rows) and all((r["position"] is None) == (r["source"] != "s1") for r in alone)
    assert mixing.mix(docs(spark, []), {"s1": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(table, {"s1": 0})


# repeats


@pytest.mark.parametrize("large", [1024, 12, 1])
def test_repeats_against_brute_force(spark, large):
    rng = random.Random(large)
    word = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(60, 140)))
    pool = [word() for _ in range(25)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randrange(0, 6))) for _ in range(120)]
    texts += [texts[0], texts[5], "", None, "z" * 500, "ab" * 300]
    table = docs(spark, list(enumerate(texts))).withColumn("spans", F.lit("x")).withColumn("h", F.lit("x"))
    rows = sorted(collected(repeats.remove_repeats(table, length=100, large_bucket=large)), key=lambda r: r["doc_id"])
    raw = [(t or "").encode() for t in texts]
    for r, t, gone in zip(rows, raw, windows_removed(raw, 100)):
        assert bytes(r["kept"]) == bytes(c for c, g in zip(t, gone) if not g)
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == sum(gone) and r["n_bytes"] == len(t)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_in_very_long_texts(spark, monkeypatch):
    rng = random.Random(0)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    filler = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    long = filler(repeats.PIECE - 350) + passage + filler(1000)
    texts = [long, filler(300) + passage + filler(50)]
    rows = sorted(collected(repeats.remove_repeats(docs(spark, list(enumerate(texts))))), key=lambda r: r["doc_id"])
    assert [len(r["kept"]) for r in rows] == [len(t) - 700 for t in texts]
    assert [len(r["spans"]) for r in rows] == [1, 1]


# packing


def test_pack_edges(spark):
    texts = {i: t or "" for i, t in [(1, None), (2, ""), (3, "a  b c \n d <|endoftext|> e"), (4, LONG), (5, " lead and trail "), (6, "x" * 5000), (7, "日本語 テキスト 🎉 " * 50)]}
    table = docs(spark, list(texts.items())).withColumn("start", F.lit("x")).withColumn("ids", F.lit("x"))
    check_pieces(collected(packing.pack(table)), texts)
    again = collected(packing.pack(docs(spark, [(None, "some words"), (8, "twice"), (8, "twice")])))
    assert Counter(r["doc_id"] for r in again) == Counter({8: 2, None: 1}) and len({(r["sequence_id"], r["offset"]) for r in again}) == 3
    assert packing.pack(docs(spark, [])).count() == 0


def test_packer_keeps_few_windows_and_no_padding():
    rng = random.Random(5)
    packer, sizes, full = packing.Packer(100, 4), [], []
    for i in range(500):
        n = rng.randrange(1, 101)
        sizes.append(n)
        full += packer.add((i, 0, n), b"\0" * 4 * n)
        assert len(packer.windows) <= 4
    assert all(sum(len(ids) for _, ids in w) == 400 for w in full)
    left = [p for w in packer.windows.values() for p in w]
    assert sum(len(ids) // 4 for w in full for _, ids in w) + sum(len(ids) // 4 for _, ids in left) == sum(sizes)


# filters and counts


def test_twice_seen_and_frequencies(spark):
    from llm.bloom import frequencies, twice_seen

    def hashes(batches):
        for batch in batches:
            yield np.asarray(batch.column(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    once, twice = range(0, 40_000), range(40_000, 50_000)
    table = spark.createDataFrame([(i,) for i in [*once, *twice, *twice]], "v long").repartition(7)
    seen = twice_seen(table, hashes, expected=60_000, max_bytes=1 << 20)
    mixed = lambda r: np.array(list(r), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert seen.holds(mixed(twice)).all() and seen.holds(mixed(once)).mean() < 0.2
    counts = frequencies(table, hashes, expected=60_000)
    assert (counts.of(mixed(twice)) >= 2).all() and (counts.of(mixed(once)) >= 1).all()
    tiny = twice_seen(table.limit(0), hashes, expected=0, max_bytes=1)
    assert not tiny.holds(mixed(once)).any() and not len(tiny.holds(mixed([])))


def plain_repeats(raws, length):
    """Bytes of each text that a string of ``length`` bytes covers which also starts elsewhere."""
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(r, gone) if not g))
    return out


@pytest.mark.parametrize("large", [1024, 20, 2])
def test_repeats_with_nul_bytes(spark, large):
    """Texts of few different bytes, NUL among them, that are copies of each other's parts; buckets whole and split once or twice."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = "".join(rng.choices("\0\0\0a\1", k=400))
        cut = rng.randrange(100, 300)
        texts += [base, base[:cut] + "\0" * rng.randrange(3) + base[cut:], "\0" * rng.randrange(4) + base[rng.randrange(100) : rng.randrange(300, 400)], base[: rng.randrange(180, 260)] + "\0" * 30]
    got = {r["doc_id"]: bytes(r["kept"]) for r in collected(repeats.remove_repeats(docs(spark, list(enumerate(texts))), large_bucket=large))}
    assert [got[i] for i in range(len(texts))] == plain_repeats([t.encode() for t in texts], 200)


def test_repeats_of_a_passage_in_very_many_texts(spark):
    """A bucket above the production limit: one passage between words of each text's own, or cut short by some."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh \0", k=320))
    texts = [f"{i} own words {i * i} " + passage[i % 7 : 320 - i % 11] + f" {i % 3} end of {i}" for i in range(1500)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in collected(repeats.remove_repeats(docs(spark, list(enumerate(texts)))))}
    assert [got[i] for i in range(len(texts))] == plain_repeats([t.encode() for t in texts], 200)


def test_filters_that_stay_on_the_executors_give_the_same_rows(spark):
    """With a limit of one byte every filter is left where it is and asked by block."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(3)
    table = table.unionByName(docs(spark, ODD).select("doc_id", "text"))
    for run in (lines.dedup_lines, shingles.similar_groups, shingles.keep_one, repeats.remove_repeats):
        wide, narrow = run(table), run(table, max_filter_bytes=1)
        assert narrow.schema == wide.schema
        assert Counter(map(repr, collected(narrow))) == Counter(map(repr, collected(wide)))
        assert run(table.limit(0), max_filter_bytes=1).count() == 0


@pytest.mark.parametrize("limit", [1 << 24, 1])
def test_filters_let_few_single_hashes_through(spark, limit):
    """Ten times as many hashes as the limit has bytes for, or well within it: below one in a hundred."""
    from llm.bloom import through_twice_seen

    def hashes(batches):
        for batch in batches:
            yield np.asarray(batch.column(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def held(seen, counts):
        def run(batches):
            for batch in batches:
                own = np.asarray(batch.column(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                found = seen.holds(own)
                assert (counts.of(own[found]) >= 1).all()
                yield batch.filter(pa.array(found))

        return run

    size, twice = 1_000_000, 2_000
    table = spark.range(size, numPartitions=7).union(spark.range(twice)).select("id")
    got = through_twice_seen(table, hashes, held, "id long", expected=size, max_bytes=limit, counted=True)
    counts = Counter(r["id"] for r in got.collect())
    assert all(counts[i] == 2 for i in range(twice))
    assert len(counts) - twice < size / 100


def test_keep_one_tells_rows_apart(spark):
    a, b = "one two three four five six seven eight", "a wholly different text of eight own words here"
    rows = [(2, a), (1, a), (2, b), (9, b + " x"), (9, b + " x"), (None, a), (None, "so alone are these words of no number"), (4, None), (4, None), (5, "")]
    kept = Counter((r["doc_id"], r["text"]) for r in collected(shingles.keep_one(docs(spark, rows), words=5, percent=80)))
    want = Counter([(1, a), (2, b), (None, "so alone are these words of no number"), (4, None), (4, None), (5, "")])
    assert kept == want
    wide = docs(spark, rows).withColumns({c: F.lit("x") for c in ("__row", "row", "best", "sig", "n")})
    out = shingles.keep_one(wide, words=5, percent=80)
    assert sorted(out.columns) == sorted(c for c in wide.columns if c != "__row") and out.count() == sum(want.values())


def test_pipeline_packs_several_files_in_the_order_of_the_mix(spark):
    """Documents of one sequence each, in files that a scan reads longest first."""
    import corpus_pipeline
    from llm.queries import REST, SHARES

    text = "a" + " a" * 1022
    names = [*[s for s, n in SHARES.items() for _ in range(n)], *["other"] * REST]
    rows = [(i, text, "en", names[i % 100], len(text)) for i in range(6_400)]
    table = spark.createDataFrame(rows, DOCS)
    mixed = sorted(collected(mixing.mix(table, SHARES, rest=REST)), key=lambda r: r["position"])
    folder, at = new_path(spark, "mixed-test"), 0
    for size in (400, 2_000, 4_000):
        part = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in mixed[at : at + size]]
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(folder)
        at += size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = collected(corpus_pipeline.pack_sequences(spark, spark.read.parquet(folder), ""))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pieces.sort(key=lambda r: r["sequence_id"])
    assert len({r["sequence_id"] >> 32 for r in pieces}) > 1
    assert [r["doc_id"] for r in pieces] == [r["doc_id"] for r in mixed]
    placed, weights = Counter(), Counter(names)
    for t, r in enumerate(pieces, 1):
        placed[names[r["doc_id"] % 100]] += 1
        if t % 32 == 0 and mixed[t - 1]["in_mix"]:
            assert all(abs(placed[s] - w * t / 100) < 32 for s, w in weights.items())
