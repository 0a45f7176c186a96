"""Each operator against a plain version of it, an exact round trip, or held-out rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stintflow.llm import decontaminate, gif, packing, pii, pitman_yor, queries, quotes, resample, simhash, substrings, toxicity
from stintflow.llm.components import connected_components


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(1)
    item = [f"word{rng.randint(0, 999)}" for _ in range(40)]
    edited = [w if k % 7 else "changed" for k, w in enumerate(item)]
    part = item[:8]
    noise = [f"noise{k}" for k in range(300)]
    rows = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + edited)), (3, " ".join(noise + part)), (4, " ".join(noise)), (5, " ".join(item).upper() + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.score for r in decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[5] == 1.0 and 0.5 < got[2] < 1


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_op2_equals_brute_force(spark, sf, texts):
    first, words = {}, {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(b" ".join(words[d][i : i + 13]), d)
    got = {r.doc_id: r for r in queries.QUERIES["op2_substrings"](spark, sf).collect()}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[b" ".join(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def _through_blocks(parts, bits):
    """For each part of sorted windows, the places that the merged sketch estimates as repeated."""
    blocks = {}
    for k, p in enumerate(parts):
        for block, b in substrings.sketch(p, 2, bits):
            blocks.setdefault(block, []).append((k, b))
    back = {}
    for block, sent in blocks.items():
        for k, b in substrings.merged_block(sent, min(bits, substrings._BLOCK_BITS)):
            back.setdefault(k, []).append((block, b))
    return [substrings.estimated_repeats(p, back.get(k, []), 2, bits) for k, p in enumerate(parts)]


@pytest.mark.parametrize("block_bits", [24, 13])
def test_sketches_never_underestimate(monkeypatch, block_bits):
    monkeypatch.setattr(substrings, "_BLOCK_BITS", block_bits)
    rng = np.random.default_rng(3)
    parts = [np.sort(substrings.mix(rng.integers(0, 3000, 1000).astype(np.uint64))) for _ in range(4)] + [np.empty(0, np.uint64)]
    whole, counts = np.unique(np.concatenate(parts), return_counts=True)
    repeated = set(whole[counts > 1].tolist())
    for p, at in zip(parts, _through_blocks(parts, 16), strict=True):
        assert {x for x in p.tolist() if x in repeated} <= set(p[at].tolist())
    for cells in (np.arange(5), np.array([7, 300, 4_000_000]), np.array([0, 255, 600, 70_000])):
        assert (substrings.unpack_cells(substrings.pack_cells(cells)) == cells).all()


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000])
def test_the_sketch_rules_out_nearly_all_single_windows_at_any_size(monkeypatch, n):
    """Blocks are scaled down, so that the sketch has up to 1,024 of them: tens of times as many as half a gigabyte needs."""
    monkeypatch.setattr(substrings, "_BLOCK_BITS", 14)
    h = substrings.mix(np.arange(n, dtype=np.uint64))
    parts = [np.sort(p) for p in np.array_split(h, 10)]
    assert sum(len(at) for at in _through_blocks(parts, substrings.sketch_bits(n))) < 0.1 * n


def test_anchors_of_texts_of_any_length():
    """Every window has one anchor, and equal windows have equal anchors."""
    h = substrings.mix(np.arange(40, dtype=np.uint64))
    for width in (1, 5, 13):
        for n in range(40):
            assert len(substrings.anchors(h[:n], width)) == len(substrings.windows(h[:n], width))
        assert (substrings.anchors(h, width)[7:] == substrings.anchors(h[7:], width)).all()


def test_repeated_rows_and_null_ids_of_substrings(spark):
    """Rows of one id never count against each other, however many parts hold them; a null id neither removes nor loses."""
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(1, text)] * 100 + [(2, text)] * 100 + [(None, text), (3, None), (4, ""), (5, "short text"), (6, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r.id, r.n_words, r.n_removed): r["count"] for r in substrings.dedup_substrings(spark, docs).groupBy("id", "n_words", "n_removed").count().collect()}
    assert got == {(None, 30, 0): 1, (1, 30, 0): 100, (2, 30, 30): 100, (3, 0, 0): 1, (4, 0, 0): 1, (5, 2, 0): 1, (6, 31, 30): 1}


def test_op3_round_trip(spark, sf, texts):
    for r in queries.QUERIES["op3_gif"](spark, sf).collect():
        raw = texts[r.doc_id].encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        assert sum(map(int, r.feature.split(","))) == len(pad)


def test_lzw_on_other_sizes_and_streams():
    rng = np.random.default_rng(4)
    for n, px, hi in ((3, 20_000, 4), (2, 9_000, 256), (5, 1, 256), (4, 577, 2)):
        f = rng.integers(0, hi, (n, px)).astype(np.uint8)
        back = gif.lzw_decode([(s, 8, px) for s in gif.lzw_encode(f)])
        assert all((a == b).all() for a, b in zip(f, back, strict=True))
    short = gif.lzw_encode(np.arange(100, dtype=np.uint8)[None])[0][:20]
    assert (gif.lzw_decode([(short, 8, 100)])[0][:10] == np.arange(10)).all()


def test_disposal_transparency_and_interlace(spark):
    import struct

    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])

    def frame(x, y, w, h, px, disposal=1, transparent=None, interlaced=False):
        code = gif.lzw_encode(np.array([px], np.uint8), 2)[0]
        flag = (disposal << 2) | (transparent is not None)
        return b"\x21\xf9\x04" + bytes([flag]) + struct.pack("<H", 5) + bytes([transparent or 0, 0]) + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlaced else 0) + b"\x02" + bytes([len(code)]) + code + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + colours
    body = frame(0, 0, 2, 2, [0, 0, 0, 0]) + frame(0, 0, 2, 1, [1, 3], 2, 3) + frame(1, 1, 1, 1, [2], 3) + frame(0, 0, 1, 1, [3])
    got = [np.frombuffer(r.rgba, np.uint8).reshape(2, 2, 4) for r in gif.timed_frames(spark.createDataFrame([(1, bytearray(head + body + b";"))], "id long, gif binary")).orderBy("frame").collect()]
    red, green, blue, white, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [255] * 4, [0] * 4
    assert got[0].tolist() == [[red, red], [red, red]]
    assert got[1].tolist() == [[green, red], [red, red]]
    assert got[2].tolist() == [[clear, clear], [red, blue]]
    assert got[3].tolist() == [[white, clear], [red, red]]
    tall = gif.parse(b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + colours + frame(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], interlaced=True) + b";")
    gif.fill([tall])
    assert tall.images[0].indices.ravel().tolist() == [0, 3, 2, 3, 1, 3, 2, 3]


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_their_format_and_link(spark):
    cards = ["4111111111111111", "5500005555555559", "4111 1111 1111 1111"]
    rows = [(1, f"pay {cards[0]} or {cards[2]}"), (2, f"{cards[0]}, {cards[1]}; no card: 4111111111111112"), (3, "2020-02-29 2020-02-30 31/12/1999 10.0.0.1 10.0.0.300 1.2.3.4.5"), (4, "+1 (212) 555-0100 mail a.b1@x.org and A.B1@x.org 078-05-1120 000-05-1120")]
    out = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key", kinds_col="kinds").collect()}
    a, b = out[1][0].split(" or ")[0][4:], out[1][0].split(" or ")[1]
    assert luhn(a) and a != cards[0] and b.replace(" ", "") == a and len(b) == 19
    assert out[2][0].startswith(a + ", ") and out[2][0].endswith("no card: 4111111111111112")
    assert out[3][1] == ["iso_date", "day_date", "ip"] and "2020-02-30" in out[3][0] and "10.0.0.300 1.2.3.4.5" in out[3][0]
    assert out[4][1] == ["phone", "email", "email", "ssn"] and out[4][0].endswith("000-05-1120")
    mails = [w for w in out[4][0].split() if "@" in w]
    assert mails[0] == mails[1] != "a.b1@x.org"


def test_feistel_is_a_permutation(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v")).select(pii.permute_symbols(F.col("v"), pii.DIGITS, "k", "t").alias("p"))
    assert d.distinct().count() == 1000 and d.filter("not p rlike '^[0-9]{3}$'").count() == 0
    n = spark.range(7 * 11).select(pii.permute_number(F.col("id"), 7, 11, "k", "t").alias("p"))
    assert sorted(r.p for r in n.collect()) == list(range(77))


def test_pii_plan_is_native(spark, sf):
    df = queries.QUERIES["op4_pii"](spark, sf)
    assert not any(w in df._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Arrow", "Pandas"))


def fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_op5_equals_brute_force(spark, sf, texts):
    fp = {d: fingerprint(t) for d, t in texts.items()}
    ids = sorted(fp)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("how", [{"blocks": 1}, {"max_group": 2}, {"max_group": 8}])
def test_ball_hashing_loses_no_link(spark, how):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4])
    got = {n: n for n in signed} | {r.node: r.component for r in connected_components(spark, simhash.links(spark, df, **how)).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(spark, edges).collect()} == {0}


def test_resampling_prefers_the_target(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = resample.gumbel_top_k(spark, resample.weights(docs, labels))
    by = {(r.quality, r.selected): r["count"] for r in got.join(labels.withColumnRenamed("doc_id", "id"), "id").groupBy("quality", "selected").count().collect()}
    assert by.get((0, True), 0) < by.get((0, False), 0) and by[(1, True)] > by.get((1, False), 0)


def test_top_k_by_counting_is_exact(spark):
    rows = [(k, float((k * 37) % 101), 0.0) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, key double, log_weight double")
    for k in (1, 19, 20, 21, 777, 1999):
        got = sorted(r.id for r in resample.gumbel_top_k(spark, df, k, bins=8, most=5).filter("selected").collect())
        assert got == sorted(r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


def check_packing(rows, limits):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(s) <= limits.documents and sum(n * n for _, n in s) <= limits.attention
    return len(seqs)


def test_op7_pieces_and_sequences(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing._default_tokenizer())
    rows = queries.QUERIES["op7_packing"](spark, sf).collect()
    want = {}
    for d, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[d, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check_packing(rows, packing.Limits()) == -(-sum(r.length for r in rows) // 4096)


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_all_capacities_hold(spark, rule):
    rng = random.Random(8)
    limits = packing.Limits(tokens=100, documents=4, attention=5000, rule=rule)
    rows = [(k, 0, 0, rng.randint(1, 70), 0) for k in range(600)]
    got = packing.pack(spark, spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), limits).collect()
    assert len(got) == 600
    assert check_packing(got, limits) < 1.15 * max(sum(r[3] for r in rows) / 100, 600 / 4, sum(r[3] ** 2 for r in rows) / 5000)


def test_odd_texts_tokenize_alike():
    from tokenizers import Tokenizer

    path = packing._default_tokenizer()
    own, tok = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    for t in ("Ünïcödé's don't I'm İstanbul ΣΑΣ. ﬁ éa ａｂｃ １２ x y z \x1c a…b 12,5. A.B.C... 😀! ñ̃", "", "　", "word‍, ʼn ß ẞ.", "A, a, A. B!! 'tis o'clock"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_nested_quotes_are_linked(spark):
    m = spark.createDataFrame([(1, 0, "user", "Hello there, my friend.\nHow are you?"), (1, 1, "assistant", "> Hello there,  my FRIEND\n\nI am fine."), (1, 2, "user", "On Monday A wrote:\n>> Hello there, my friend.\n> I am fine.\nGood!"), (1, 3, "user", "unrelated"), (2, 0, "user", "> I am fine.\nx")], "conv_id long, turn long, role string, text string")
    got = {(r.conv, r.turn): r for r in quotes.link_quotes(spark, m).collect()}
    assert [(got[k].reply_to, got[k].thread_root, got[k].depth, got[k].n_quoted, got[k].n_linked) for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0))] == [(None, 0, 0, 0, 0), (0, 0, 1, 1, 1), (1, 0, 2, 2, 2), (None, 3, 0, 0, 0), (None, 0, 0, 1, 0)]
    assert got[1, 2].text == "Good!" and got[1, 1].text == "I am fine."
    order = [(r.conv, r.turn) for r in quotes.link_quotes(spark, m).collect()]
    assert order == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert "Python" not in quotes.link_quotes(spark, m)._jdf.queryExecution().executedPlan().toString()


def test_language_model_base_and_gain(spark, sf, texts):
    import math
    from collections import Counter

    got = queries.QUERIES["op9_pitman_yor"](spark, sf).collect()
    toks = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    count = Counter(w for d, t in toks.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for r in got:
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks[r.doc_id]), rel=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(toks[r.doc_id]), sum(count[w] > 0 for w in toks[r.doc_id]), n)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _trigram_model(docs, s):
    """A bucket of all tokens of docs (lists of words), with the root given: what the operator's tasks hold."""
    buffer = pitman_yor.Buffer()
    for d in docs:
        buffer.add(" ".join(d))
    two, before, w, text = buffer.columns()
    h = buffer.hashes()
    n = np.bincount(w, minlength=len(h))
    head = pitman_yor.Head(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0), 1.0 / (int((n > 0).sum()) + 1))
    order = np.argsort(before, kind="stable")
    codes = np.full(len(h), -1)
    values = [v for _, v in pitman_yor._blobs(np.zeros(len(w), np.int64), [before[order], two[order], w[order]], head, h, codes, lambda part: (text[order][part].astype(np.uint32),))]
    own = pitman_yor.Contents(values, head, 2)
    at = pitman_yor._order([own.context, *own.words], [len(own.contexts), own.n_codes, own.n_codes])
    context, two, word = own.context[at], own.words[0][at], own.words[1][at]
    first = pitman_yor._starts(context, two, word)
    c3 = pitman_yor._sizes(first, len(word))
    return own, head, two[first], context[first], word[first], c3


def test_probabilities_add_up_and_more_customers_weigh_more():
    rng = random.Random(4)
    docs = [[f"w{min(int(rng.expovariate(0.3)), 20)}" for _ in range(30)] for _ in range(40)]
    s = pitman_yor.Settings()
    own, head, two, context, word, c3 = _trigram_model(docs, s)
    tables = [pitman_yor.log_stirling(d) for d in s.discount]
    # Types that were never seen are asked for along with the seen ones: every word in every context of two words.
    pairs = sorted(set(zip(context.tolist(), two.tolist(), strict=True)))
    dishes = sorted(set(word.tolist()))
    seen = dict(zip(zip(context.tolist(), two.tolist(), word.tolist(), strict=True), c3.tolist(), strict=True))
    every = [(c, t, w) for c, t in pairs for w in dishes]
    full = np.array(every)
    counts = np.array([seen.get(x, 0) for x in every])
    alpha, beta = pitman_yor.seat_bucket(own, head, full[:, 1], full[:, 0], full[:, 2], counts, s, tables)
    p = alpha + beta * head.other_p
    by = defaultdict(float)
    for (c, t, _), x, b in zip(every, p, beta, strict=True):
        by[c, t] += x
        rest = b * head.other_p  # an unseen word has the back-off mass alone
    for (c, t), total in by.items():
        unseen = float(beta[[k for k, x in enumerate(every) if x[:2] == (c, t)][0]]) * head.other_p
        assert total + unseen == pytest.approx(1.0)
    assert p[counts > 3].mean() > p[counts == 0].mean() and rest > 0


def test_table_numbers_follow_their_law():
    d, a, c = 0.5, 0.7, 6
    table = pitman_yor.log_stirling(d)
    u = pitman_yor.uniforms(np.arange(20_000, dtype=np.uint64), 1)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    w = np.exp(table[c, 1 : c + 1]) * a ** np.arange(1, c + 1)
    got = np.bincount(pitman_yor.draw_tables(np.full(20_000, c), np.full(20_000, a), d, table, u), minlength=c + 1)[1:]
    assert np.abs(got / 20_000 - w / w.sum()).max() < 0.02
    # The law beyond the exact range against the exact law at its end.
    n = pitman_yor._EXACT
    for weight in (0.05, 0.7, 5.0, 80.0):
        logits = table[n, 1 : n + 1] + np.log(weight) * np.arange(1, n + 1)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        exact = float((p * np.arange(1, n + 1)).sum())
        assert 1 + pitman_yor.poisson_mean(np.array([n]), np.array([weight]), d)[0] == pytest.approx(exact, rel=0.022)
        drawn = pitman_yor.draw_tables(np.full(4000, n + 1), np.full(4000, weight), d, table, u[:4000])
        assert drawn.mean() == pytest.approx(exact, rel=0.04)


def test_language_model_beats_a_plain_bigram_and_ignores_partitions(spark):
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = []
    for n in (4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scores.append({r.id: r.score for r in pitman_yor.model_scores(spark, docs.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert scores[0] == scores[1]
    toks = {r.doc_id: ["<", *(r.text or "").encode().lower().split(), ">"] for r in docs.collect()}
    train = [t for d, t in toks.items() if not pitman_yor.held_out(d)]
    one, two = Counter(w for t in train for w in t[1:]), Counter(x for t in train for x in zip(t, t[1:]))
    after, kinds = Counter(), Counter()
    for (a, _), c in two.items():
        after[a] += c
        kinds[a] += 1
    n, v = sum(one.values()), len(one)
    total, tokens = 0.0, 0
    for d, t in toks.items():
        if pitman_yor.held_out(d):
            for a, b in zip(t, t[1:]):
                p = (one[b] + 1) / (n + v + 1)
                total += np.log10((max(two[a, b] - 0.75, 0) + 0.75 * kinds[a] * p) / after[a] if after[a] else p)
                tokens += 1
    ours = sum(x for d, x in scores[0].items() if pitman_yor.held_out(d))
    assert 10 ** (-ours / tokens) < 0.7 * 10 ** (-total / tokens)


def test_split_restaurants_still_score_all_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.id: r for r in pitman_yor.model_scores(spark, docs).collect()}
    split = {r.id: r for r in pitman_yor.model_scores(spark, docs, settings=pitman_yor.Settings(split=300, bucket=5_000, head=2_000)).collect()}
    assert {d: (r.n_tokens, r.n_known, r.train_tokens) for d, r in whole.items()} == {d: (r.n_tokens, r.n_known, r.train_tokens) for d, r in split.items()}
    assert all(split[d].base_score == pytest.approx(r.base_score, rel=1e-9) and split[d].score < 0 for d, r in whole.items())


@pytest.mark.parametrize("sizes", [{"head": 200}, {"head": 0, "bucket": 5_000}, {"split": 300}])
def test_sizes_that_deal_work_change_no_score(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.id: r for r in pitman_yor.model_scores(spark, docs).collect()}
    dealt = {r.id: r for r in pitman_yor.model_scores(spark, docs, settings=pitman_yor.Settings(**sizes)).collect()}
    assert whole.keys() == dealt.keys()
    for d, r in whole.items():
        assert (r.n_tokens, r.n_known) == (dealt[d].n_tokens, dealt[d].n_known)
        assert dealt[d].score == pytest.approx(r.score, abs=1e-5) and dealt[d].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_chain_on_held_out_rows(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for k in range(1200):
        insult, threat = rng.random() < 0.3, rng.random() < 0.2
        ws = [f"w{rng.randint(0, 300)}" for _ in range(40)] + ["idiot"] * insult + ["hurt"] * threat
        rng.shuffle(ws)
        rows.append((k, " ".join(ws)))
        labels.append((k, int(insult), int(threat), int(insult or threat)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, insult int, threat int, toxic int")
    cats = ["insult", "threat", "toxic"]
    got = toxicity.toxicity(spark, docs, lab.filter("doc_id % 2 = 0"), cats).join(lab.withColumnRenamed("toxic", "y").select("doc_id", "y"), "doc_id").filter("doc_id % 2 = 1")
    assert got.filter("toxic = (y = 1)").count() / got.count() > 0.97
