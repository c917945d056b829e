"""The training-data operators against plain versions, and their edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from . import brute
from reelspark.llm import exact_dedup, lang_id, lm_scoring, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, warc_audit
from reelspark.llm.common import Tables, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, n int, size int, start int, row int"
SF = "/root/testdata/sf0.001"


def make(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", 1, 2, 3, 4, 5) for i, t, lang, s in rows], SCHEMA)


def make_clashing(spark, rows):
    """documents whose other columns are named like helper columns."""
    names = ["_id", "_copies", "_kept_id", "_row_id", "_row_t1", "t1", "t2", "key", "place", "_t1", "component", "rows"]
    return spark.createDataFrame([(i, t, None, "s", *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 260))) for _ in range(40)]
    texts = list(base)
    for b in base[:12]:
        words = b.split()
        for _ in range(4):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [f"{b}\n{passage}\n{rng.choice(vocab)}" for b in base[20:30]]
    texts += [None, "", " \n\t", "one", "two words", "One", "a" * 500, "x y z " * 200, "é ü 😀\x0b\x0c z", "a  b", "a\n\tb"]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None])) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def test_exact_dedup(docs, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(norm(t), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for key_bits in (64, 4):  # 4: few keys, long chains, told apart by their bytes
        assert {r[0]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs, 4, key_bits).collect()} == want
    t = Tables(docs.sparkSession)
    buckets, index = exact_dedup.build_index(docs, t, 4)
    sizes = {(r.local_depth, r.bucket): r.entries for r in buckets.collect()}
    assert max(sizes.values()) <= 4 and len({d for d, _ in sizes}) > 1  # split where overfull, and only there
    assert sum(sizes.values()) == index.count() == len(groups)
    assert exact_dedup.probe(docs, buckets.filter("false"), index).count() == 0  # no way around the directory
    some = buckets.filter("bucket % 2 = 0")
    assert 0 < exact_dedup.probe(docs, some, index).count() < len(corpus)


def test_exact_dedup_keeps_one_row_of_a_group(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (2, "c d"), (None, "c\td"), (None, "e"), (None, "e"), (3, None), (4, "")]
    docs = make_clashing(spark, rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a b"), (2, "c d"), (None, "e"), (3, "")], key=str)


def test_quality(docs, corpus):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(docs).collect()}
    assert got == {i: brute.quality(t) for i, t, *_ in corpus}
    assert not quality.measure("one two three four five six seven\n" * 20)["kept"]
    assert quality.measure(" ".join(f"w{i}" for i in range(80)))["kept"]


def test_packing(docs, corpus):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in corpus}
    rows = packing.pack(docs).collect()
    seen, fill = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, spans in seen.items():
        assert [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == len(ids[i])
    assert set(seen) == set(ids)
    for spans in fill.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert len(fill) == -(-sum(map(len, ids.values())) // 1024)


def test_ids_are_the_tokenizers(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, encode, rng = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder(), random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "\n\n", "\t", "word", "Word's", "42", "é", "😀", "\u00a0", ".", "##"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], x


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("heads_first", [True, False])
def test_ngram_join(docs, corpus, heads_first):
    assert as_rows(ngram_join.jaccard_components(docs, heads_first)) == brute.jaccard_components([(i, t) for i, t, *_ in corpus])


def test_ngram_join_by_rows(spark):
    rng = random.Random(12)
    text = lambda: [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(90)]
    x, y, z = text(), text(), text()
    near = lambda w, i: " ".join(["new", *w[1:]] if i == 0 else [*w[:-1], f"end{i}"])
    rows = [(None, " ".join(x)), (None, " ".join(y)), (5, near(x, 0)), (6, near(y, 0)), (7, near(x, 3)), (7, " ".join(z)), (8, near(z, 0)), (None, near(z, 5)), (9, "a b"), (9, "A  b"), (None, "alone")]
    assert as_rows(ngram_join.jaccard_components(make_clashing(spark, rows))) == brute.jaccard_components(rows)
    kept = ngram_join.keep_one(make_clashing(spark, [*rows, rows[2], (None, None), (None, ""), (3, " ")]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(5, rows[2][1]), (6, rows[3][1]), (7, rows[5][1]), (9, kept.filter("doc_id = 9").first().text), (None, "alone"), (None, None), (None, ""), (3, " ")], key=str)


@pytest.mark.parametrize("heads_first", [True, False])
def test_ngram_join_of_large_blocks(spark, monkeypatch, heads_first):
    """A passage that most texts share and large near groups: blocks far over a chunk, in linear output."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "MOST_CHUNK", 16)
    monkeypatch.setattr(ngram_join, "HEAVY", 1000)
    rng = random.Random(3)
    passage = [f"longpassageword{i}" for i in range(40)]
    texts = [[*passage, *(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(30))] for _ in range(60)]
    for base in texts[:3]:
        texts += [[*base[: rng.randint(0, 69)], f"v{rng.randint(0, 9)}", *base[-2:]] if i % 9 == 0 else [*base[:-1], f"w{i}"] for i in range(50)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert as_rows(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), heads_first)) == brute.jaccard_components(rows)


@pytest.mark.parametrize("heavy", [2, 64])
def test_ngram_join_with_heavy_shingles(spark, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rng = random.Random(5)
    common = [" ".join(f"extraordinarily{k}long{j}" for j in range(8)) for k in range(30)]
    texts = [" ".join([*rng.sample(common, 12), *(f"u{rng.randint(0, 3000)}" for _ in range(60))]) for _ in range(40)]
    texts += [t + f" tail{i}" for i, t in enumerate(texts[:15])]
    rows = list(enumerate(texts))
    assert as_rows(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.jaccard_components(rows)


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(0, 1 << 40, 1, dtype=np.uint64)])) for s in sets]
    tree, order = ngram_join.tree_of([len(s) for s in sets], [ngram_join.bitmap(s) for s in sets], np.arange(len(sets)))
    found = {(min(p), max(p)) for p in zip(*(order[x].tolist() for x in tree.pairs()))}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 10 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 9 * (len(sets[i]) + len(sets[j]) - o)}
    assert want and want <= found


@pytest.mark.parametrize("low, high", [(127, 129), (128, 131), (250, 262), (505, 520)])
def test_links_across_bitmap_widths(low, high):
    rng = np.random.default_rng(low)
    sets = []
    for _ in range(30):
        wide = np.unique(rng.integers(0, 1 << 40, high, dtype=np.uint64))
        sets += [wide, rng.permutation(wide)[:low], np.concatenate([wide[3:], rng.integers(1 << 41, 1 << 42, 3, dtype=np.uint64)])]
    batch = pa.RecordBatch.from_pydict({
        "block": pa.array([1] * len(sets), pa.int64()), "row": pa.array(range(len(sets)), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()),
        "bits": [ngram_join.bitmap(s) for s in sets], "comp": pa.array(range(len(sets)), pa.int64()), "set": [s.tobytes() for s in sets]})
    near = [p for b in ngram_join.hits(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(near) == 60 and len(set(brute.components(near, range(90)).values())) == 30
    found = [p for b in ngram_join.forests(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) == 60 and len(set(brute.components(found, range(90)).values())) == 30


def test_components_of_long_chains(spark):
    rng, edges, want = random.Random(8), [], {}
    for at in (0, 10_000):  # ids in random order along a chain, its diameter far over 60
        chain = rng.sample(range(at, at + 10_000), 700)
        edges += list(zip(chain, chain[1:]))
        want |= dict.fromkeys(chain, min(chain))
    frame = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
    assert {r.node: r.component for r in components(frame).collect()} == want


def test_suffix_dedup(docs, corpus, monkeypatch):
    want = brute.suffix_dedup([(i, t) for i, t, *_ in corpus])
    for least in (64, 2):
        monkeypatch.setattr(suffix_dedup, "LEAST", least)
        assert as_rows(suffix_dedup.suffix_dedup(docs)) == want


def test_suffix_dedup_by_rows_and_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = random.Random(9)
    words = lambda n: " ".join(f"{rng.randint(0, 10**6)}" for _ in range(n))
    passage = words(40)
    rows = [(None, f"{passage} {words(20)} {passage}"), (None, words(300)), (4, words(200)), (4, f"{words(9)} {passage}"), (2, words(700) + passage), (3, None), (3, "short")]
    assert as_rows(suffix_dedup.suffix_dedup(make_clashing(spark, rows))) == brute.suffix_dedup(rows)
    twice = as_rows(suffix_dedup.suffix_dedup(make_clashing(spark, [*rows, rows[0], rows[4]])))
    assert sorted(set(twice), key=str) == brute.suffix_dedup(rows) and len(twice) == 9


def test_mixing(docs, corpus):
    rows = mixing.mix(docs).collect()
    sizes, taken, goal, ranks = {}, {}, {}, {}
    source = {i: s for i, _, _, s in corpus}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(brute.WORD.findall(dict((i, t) for i, t, *_ in corpus)[r.doc_id] or "")) and r.taken <= 3 * r.size
        sizes[s], taken[s], goal[s], ranks[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target, r["rank"]
    want = brute.targets(sizes)
    assert all(abs(goal[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= max(16, want[s] / 256) for s in sizes)
    assert sum(taken.values()) == sum(sizes.values())
    plain = brute.mixture([(r.doc_id, r.size, r["rank"]) for r in rows], {ranks[s]: (goal[s], sizes[s]) for s in sizes})
    assert {r.doc_id: r.taken for r in rows if r.taken} == {d: n for d, n in plain.items() if n}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_cuts_by_the_global_order(docs, monkeypatch):
    right = sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    total = mixing.running_total

    def unsorted(df, order, value, out, t):  # the merge by finish time left out: queues one after another
        return total(df, order if out != "spent" else order[1:], value, out, t)

    monkeypatch.setattr(mixing, "running_total", unsorted)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) != right


def test_mixed_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e f"), (None, "e f"), (2, None), (3, "g " * 50)]
    docs = make_clashing(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)  # one source: all stay
    skewed = spark.createDataFrame([(i, "w " * 10, "a" if i < 30 else "b", i) for i in range(40)], "doc_id long, text string, source string, _copy int")
    n = {r.source: r["count"] for r in mixing.mixed(skewed).groupBy("source").count().collect()}
    assert n == {"a": 13, "b": 27} or n == {"a": 14, "b": 26}  # 1 : 2 of 40


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    code = lang_id.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 8


def test_lm_scores(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    rows = lm_scoring.cross_entropy_difference(docs, labels).collect()
    good, rest = [r.score for r in rows if r.doc_id < 20 and r.n_tokens], [r.score for r in rows if r.doc_id >= 20 and r.n_tokens]
    assert np.mean(good) > np.mean(rest) and all(r.score == 0 for r in rows if not r.n_tokens)


def test_lm_losses_are_of_whole_corpora(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 200_000)
    rows = [(i, t) for i, t, *_ in corpus] + [(1000 + i, f"v{i} y{i % 7} v{i} v{i // 2}") for i in range(20_000)] + [(7, corpus[7][1]), (None, "y1 y2"), (None, None)]
    good = {i for i, _ in rows if i is not None and (i % 3 or i >= 2000)}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 1) for i in list(good)[:50]] + [(0, 0), (None, 1)], "doc_id long, quality int")
    line = lambda d, n, *x: (str(d), n, *(round(v, 9) + 0.0 for v in x))
    want = sorted(line(d, n, bg, tg, bg - tg) for d, n, bg, tg in brute.lm_losses(rows, good))
    for fan in (1 << 13, 1):  # one step, and two
        monkeypatch.setattr(lm_scoring, "FAN", fan)
        got = lm_scoring.cross_entropy_difference(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3), labels).collect()
        assert all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-8) for a, b in zip(sorted(line(*r) for r in got), want, strict=True))


def test_warc_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>e{i}é</p>" if i % 7 else None) for i in range(300)] + [(5, "u", "twice"), (5, "u", "thrice"), (None, None, "z"), (None, "n", "z" * 99)]
    schema = "page_id long, url string, html string, start int, records int, archive int"
    frame = lambda rows: spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    pages, folder = frame(rows), iter(range(99))

    def compared(other):
        path = f"{tmp_path}/{next(folder)}"
        warc_audit.write_warc(frame(other), path, 64)
        stored = warc_audit.stored_records(warc_audit.read_warc(spark, path))
        return {(r.page_id, r.status) for r in warc_audit.fixity_audit(warc_audit.page_records(pages), stored, 64).collect()}

    assert compared(rows) == compared(rows[::-1]) == set()
    assert compared([r for r in rows if r[0] != 100]) == {(100, "missing")}
    assert compared([*rows, (-4, "new", "page")]) == {(-4, "added")}
    assert compared([(i, u, h + "!" if i == 65 else h) for i, u, h in rows]) == {(65, "changed")}
    assert compared([(i, u, "twicE" if h == "twice" else h) for i, u, h in rows]) == {(5, "changed")}
    assert compared([r for r in rows if r[2] != "z"]) == {(None, "missing")}
    assert compared([]) == {(r[0], "missing") for r in rows}


def test_warc_files_are_read_as_far_as_they_go(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"é\n\r\n\r\nWARC/1.{i}") for i in range(4)], "page_id long, url string, html string")
    text = b"".join(r.record.encode() + b"\r\n\r\n" for r in warc_audit.written(pages).orderBy("page_id").collect())
    found = list(warc_audit.parsed(text))
    assert [r[2] for r in found] == [0, 1, 2, 3] and [r[4].decode() for r in found] == [f"é\n\r\n\r\nWARC/1.{i}" for i in range(4)]
    assert sum(r[1] for r in found) == len(text) and [r[0] for r in found][1] == found[0][1]
    size = found[0][1]
    for bad, good in ((text[:-9], {0, 1, 2}), (b"junk" + text, {0, 1, 2, 3}), (text[:size] + b"junk\r\n\r\n" + text[size:], {0, 1, 2, 3}), (text.replace(b"Content-Length", b"Content-Lengt", 1), {1, 2, 3}), (text[: size + 20], {0}), (b"", set())):
        rows = list(warc_audit.parsed(bad))
        assert {r[2] for r in rows if r[6] is None} >= good - {0} if good else rows == []
        assert (not bad) or any(r[6] for r in rows)
    (tmp_path / "cut.warc").write_bytes(text[: size + 40] + b"\xff\xfe")
    rows = warc_audit.read_warc(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.page_id, r.error) for r in rows] == [(0, None), (None, "header is cut off")]


def test_one_bad_byte_costs_one_record(spark, tmp_path):
    import glob

    rows = [(i, f"http://a/{i}\r\n\r\nWARC/1.1" if i % 9 == 0 else f"http://a/{i}", f"<p>{i}</p>\r\n" * (i % 5)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc_audit.write_warc(pages, path)
    assert warc_audit.audit_stored(pages, path).collect() == []  # urls with line ends, too
    (file,) = glob.glob(f"{path}/part-*")
    for sums in glob.glob(f"{path}/.*.crc"):  # the local file system's own checksums
        os.remove(sums)
    whole = open(file, "rb").read()
    found = list(warc_audit.parsed(whole))
    for n, place in ((17, b"response"), (63, b"<p>"), (88, b"Content-Length: "), (119, b"WARC/1.1")):
        start = found[n][0]
        at = whole.index(place, start) + len(place) - (place != b"Content-Length: ")
        with open(file, "wb") as f:
            f.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        got = warc_audit.audit_stored(pages, path).collect()
        assert {r.page_id for r in got if r.status != "unreadable"} == {n}
        assert all(start <= r.found_start < r.found_stop <= start + found[n][1] for r in got if r.found_start is not None)
        assert {r.status for r in got} in ({"changed"}, {"missing", "unreadable"})


def test_compressed_files_are_read_on_behind_a_break():
    import gzip

    parts = [b"x" * 400 + bytes([i]) * 50_000 + bytes(range(256)) * 40 for i in range(6)]
    members = [gzip.compress(p) for p in parts]
    assert warc_audit.inflated(b"".join(members)) == b"".join(parts)
    broken = bytearray(members[2])
    broken[-6] ^= 1  # its checksum
    for bad in (bytes(broken), members[2][: len(members[2]) // 2], members[2][:3]):
        got = warc_audit.inflated(b"".join([*members[:2], bad, *members[3:]]))
        assert got.startswith(b"".join(parts[:2])) and got.endswith(b"".join(parts[3:]))
    assert warc_audit.inflated(b"plain") == b"plain" and warc_audit.inflated(b"") == b""


def test_toxicity_finds_pairs_without_single_signal():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (3000, 2))
    docs = [[10 + 50 * int(a), 20 + 50 * int(b), *(300 + np.unique(rng.integers(0, 400, 12))).tolist()] for a, b in bits]
    y = bits[:, 0] ^ bits[:, 1]  # only pairs tell
    m = toxicity.learn([sorted(d) for d in docs[:2000]], y[:2000], float(y[:2000].mean()))
    rest = [m.slots[np.array(d)] for d in docs[2000:]]
    right = (m.margins([d[d >= 0] for d in rest]) > 0) == y[2000:]
    flat = toxicity.Machine(m.slots, len(m.w), np.random.default_rng(0))
    flat.bias, flat.w, flat.v = m.bias, m.w, np.zeros_like(m.v)
    linear = (flat.margins([d[d >= 0] for d in rest]) > 0) == y[2000:]
    assert right.mean() > 0.95 and linear.mean() < 0.8


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    hot, cold = ([r.score for r in rows if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in hot for b in cold]) > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_confusion(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in lang_id.identify(docs).collect() if r.held_out and truth[r.doc_id]]
    for lang in {truth[r.doc_id] for r in rows}:
        mine = [r.lang_pred == lang for r in rows if truth[r.doc_id] == lang]
        assert np.mean(mine) > 0.85, (lang, len(mine))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_dedup(none), quality.quality(none), packing.pack(none), ngram_join.jaccard_components(none), mixing.mix(none),
        lang_id.identify(none), suffix_dedup.suffix_dedup(none), toxicity.toxicity(none, labels), lm_scoring.cross_entropy_difference(none, labels),
        lang_id.recognised(none), exact_dedup.keep_first(none), ngram_join.keep_one(none), mixing.mixed(none),
    ):
        assert out.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_audit.stored_audit(pages, pages).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = make(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, "en", None), (None, text, None, "s"), (None, None, None, None)])
    assert [r.group_size for r in exact_dedup.exact_dedup(docs).filter("text_sha256 <> sha2('', 256)").collect()] == [4] * 4
    for out in (quality.quality(docs), ngram_join.jaccard_components(docs), mixing.mix(docs), lang_id.identify(docs), suffix_dedup.suffix_dedup(docs)):
        assert out.count() == 5
    assert packing.pack(docs).agg({"length": "sum"}).first()[0] > 4 * 60


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() > 0
        if name == "exact_dedup":
            assert out.count() == out.selectExpr("regexp_replace(text, '[ \\t-\\r]+', ' ') AS t").distinct().count()
        if name == "ngram_jaccard_join":
            left = brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id for r in out.collect()} == {d for d, _, c in left if d == c}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg({"length": "sum"}).first()[0] > 0
