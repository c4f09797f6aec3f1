"""The training-data operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import dataclasses
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("crawlsight.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from crawlsight.llm import chat, decontaminate, idstore, jaccard, lattice, packing, quality, secrets, sharding, wrapper  # noqa: E402
from crawlsight.llm.common import Store, WordEncoder  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string, _n int, row string, sig string, n int, c string"


def docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "en", 1, "r", "x", 2, "y") for i, t in texts], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "su"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 6000)
    return [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (5, long), (6, long + " more"), (7, " \n\t "), (8, prose(2, 50))]


def test_plan_is_best_fit_decreasing():
    for seed in range(60):
        r = random.Random(seed)
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for length, _, n, k, b0, _ in packing.plan(counts, 40):
            for j in range(n * k):
                used[b0 + j // k] = used.get(b0 + j // k, 0) + length
        left = []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, c in enumerate(left) if c >= n]
            if fit:
                best = min(fit, key=lambda i: left[i])
                left[best] -= n
            else:
                left.append(40 - n)
        assert len(used) == len(left) and all(u <= 40 for u in used.values())


def test_packing(spark, odd):
    rows = packing.pack(docs(spark, odd), TOKENIZER).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


def test_parts_of_a_length_grow_with_it(spark, monkeypatch):
    assert packing._parts({}, 3) == [32] * 4
    grown = packing._parts({4096: 6_000_000_000, 7: 10}, 4096)
    assert grown[7] == 32 and grown[4096] > 200_000 and sum(grown) <= packing.MOST_PARTS + 33 * 4097
    monkeypatch.setattr(packing, "PART_BYTES", 64)
    monkeypatch.setattr(packing, "LEAST_PARTS", 1)
    pieces = spark.createDataFrame([(i, 0, 0, 8 if i % 3 else 3) for i in range(300)], "doc_id long, piece int, start long, length long")
    placed = packing.assign(pieces, 16).collect()
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(placed) == 300 and len(by) == 120  # 200 eights in 100, 100 threes in 20
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 16


def test_id_store_round_trip(spark, odd, tmp_path):
    path = Store(spark, "t").path("s")
    idstore.write(docs(spark, odd), path, TOKENIZER)
    told = {(r.start): r for r in idstore.digests(spark, path).collect()}
    at = 0
    for r in idstore.documents(spark, path).orderBy("start").collect():
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        assert (told[r.start].ids_crc32, told[r.start].doc_id) == (zlib.crc32(r.ids), r.doc_id)
        at += r.n_tokens
    assert len(told) == len(odd) and idstore.verify_manifest(spark, path).count() == 0
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = Store(spark, "t").path("e")
    idstore.write(docs(spark, []), empty, TOKENIZER)
    assert idstore.digests(spark, empty).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fuzz(seed, n):
    r = random.Random(seed)
    letters = "abAB .,'<|>éÉİßſKΣσς\x1c\x1f\x85\xa0\u3000\x0b  \n\t\r09½漢字ªﬁ́éḀ😀-_"
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*made, None, "", "<|endoftext|> hi", "don't WE'LL", "x" * 5000, "Ab, " * 4000]


def test_encoder_is_the_library():
    for limit, at_once in ((1_000_000, 3_000_000), (300, 500)):
        enc = WordEncoder(TOKENIZER, limit=limit)
        enc.AT_ONCE = at_once
        for seed in range(3):
            texts = fuzz(seed, 400) + [prose(seed, 300)]
            ids, stops = enc.encode(texts, 1)
            assert [x.tolist() for x in np.split(ids, stops[:-1])] == library_ids(texts)
    ids, stops = enc.encode([], 1)
    assert len(ids) == len(stops) == 0
    whole = WordEncoder(TOKENIZER, by_word=False).encode(texts, 1)
    assert [x.tolist() for x in np.split(whole[0], whole[1][:-1])] == library_ids(texts)


def test_pieces_and_store_hold_the_librarys_ids(spark):
    texts = [*fuzz(7, 100), prose(1, 5000)]
    wanted = library_ids(texts)
    pieces = packing.token_pieces(docs(spark, list(enumerate(texts))), TOKENIZER).collect()
    got = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(r.ids) // 4
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == dict(enumerate(wanted))
    path = Store(spark, "t").path("ids")
    idstore.write(docs(spark, list(enumerate(texts))), path, TOKENIZER)
    read = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in idstore.documents(spark, path).collect()}
    before = np.cumsum([0] + [len(w) for w in wanted]).tolist()
    assert read == {i: (before[i], w) for i, w in enumerate(wanted)}
    assert len(idstore.root(spark, path)) == 32


def test_lost_chunks_are_noticed(spark):
    path, other = Store(spark, "t").path("a"), Store(spark, "t").path("b")
    idstore.write(docs(spark, [(i, prose(i, 400)) for i in range(6)]), path, TOKENIZER)
    chunks = spark.read.parquet(f"{path}/chunks")
    gone = chunks.orderBy("digest").first().digest
    chunks.where(F.col("digest") != F.lit(gone)).write.parquet(f"{other}/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{other}/recipes")
    for read in (idstore.digests, idstore.documents):
        with pytest.raises(Exception, match="cannot be put together"):
            read(spark, other).collect()
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    spark.read.parquet(f"{path}/tree").write.parquet(f"{other}/tree")
    assert idstore.verify_manifest(spark, other).count() == 0
    spark.read.parquet(f"{path}/recipes").where("doc_id <> 3").write.mode("overwrite").parquet(f"{other}/recipes")
    assert idstore.verify_manifest(spark, other).count() > 0


def test_cuts_follow_content():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 49000, 9000).astype("<u4"), r.integers(0, 49000, 100).astype("<u4")
    one, two, three = idstore.cut_points(np.concatenate([a, b, b, a]), np.array([9000, 9100, 18200]))
    assert one == idstore.cut_points(a, np.array([9000]))[0] and two == [100] and one[-1] == 9000
    assert len({x + 100 for x in one} & set(three)) > len(one) // 2  # moved by 100, most cuts are where they were
    assert all(y - x <= idstore.MOST for x, y in zip([0, *one], one))


def test_crc_of_parts():
    a, b, c = b"x" * 100, b"", bytes(range(256)) * 9
    assert idstore.crc_joined([zlib.crc32(x) for x in (a, b, c)], [len(a), len(b), len(c)]) == zlib.crc32(a + b + c)


def plain_shingles(text, n):
    """Word shingles as tuples, by the contract and without the operator's code."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(texts, n, num):
    """[(doc_id, size, smallest doc_id reachable)] of all rows, every pair of rows compared."""
    sets = [plain_shingles(t, n) for _, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if None not in (texts[a][0], texts[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((i, len(s), None if i is None else least[find(at)]) for at, ((i, _), s) in enumerate(zip(texts, sets))), key=str)


def variants(seed, base, n, most):
    """Texts that each differ from ``base`` in up to ``most`` words, so that some link with few others only."""
    out = []
    for i in range(n):
        r = random.Random(seed * 1000 + i)
        words = list(base)
        for _ in range(r.randint(0, most)):
            words[r.randrange(len(words))] = "x" + str(r.randrange(9))
        out.append(" ".join(words))
    return out


def test_signed_sets_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILE_ROWS", 50, raising=False)
    seen, buckets = [], jaccard._buckets

    def counted(store, groups, ks):
        signed = spark.read.parquet(store.path("signed"))
        seen.extend(r["count"] for r in signed.groupBy(F.input_file_name()).count().collect())
        return buckets(store, groups, ks)

    monkeypatch.setattr(jaccard, "_buckets", counted)
    rows = jaccard.similar(docs(spark, [(i, prose(i // 2, 30)) for i in range(220)]).coalesce(1), 4, 85).collect()
    assert sum(seen) == 220 and max(seen) <= 50
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i - i % 2) for i in range(220)}


def test_store_deletes_what_it_shuffled(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = disk.getAllFiles().mkString(" ").split()
        return {n for n in (x.rsplit("/", 1)[-1] for x in names) if n.startswith("shuffle_")}

    before, store = shuffled(), Store(spark, "test")
    out = store.put(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 5000 and out.agg(F.sum("s")).first()[0] == 19_999 * 10_000
    # other queries are left as they are
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_jaccard_counts_signatures_in_parts_and_drops_them(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTS", 3, raising=False)
    parts, signed, put = [], [], Store.put

    def watched(self, df, name, *more):
        out = put(self, df, name, *more)
        if name.startswith("found"):
            parts.append({r[0] for r in out.select(F.pmod("sig", F.lit(3))).distinct().collect()})
        if name.startswith("pairs"):
            signed.append(os.path.exists(self.path("signed")))
        return out

    monkeypatch.setattr(Store, "put", watched)
    rows = jaccard.similar(docs(spark, [(i, prose(i // 2, 30) + " more" * (i % 2)) for i in range(60)]), 4, 80).collect()
    assert parts == [{0}, {1}, {2}]
    assert signed and not any(signed)
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i - i % 2) for i in range(60)}


@pytest.mark.parametrize(("n", "num", "left", "sent"), [(4, 85, jaccard.LEFT, jaccard.SENT_ROWS), (5, 80, 0, 0)])
def test_jaccard_against_brute_force(spark, odd, n, num, left, sent, monkeypatch):
    texts = list(odd)
    texts += [(100 + i, t) for i, t in enumerate(variants(1, prose(5, 120).split(), 60, 6))]
    texts += [(200 + i, " ".join(prose(9, 12).split()[: 5 + i])) for i in range(8)]
    texts += [(300 + i, t) for i, t in enumerate(variants(2, prose(6, 60).split(), 50, 5))]
    texts += [(None, texts[20][1]), (1000, "A\x0bB\x1cc d"), (1001, "a b\x1cC D"), (5, prose(31, 80)), (1010, prose(31, 80) + " x"), (5, prose(32, 80)), (1011, prose(32, 80) + " x")]
    wanted = brute_components(texts, n, num)
    monkeypatch.setattr(jaccard, "LEFT", left)
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    rows = jaccard.similar(docs(spark, texts), n, num, ("source",)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == wanted
    assert jaccard.similar(docs(spark, []), n, num).count() == 0


def test_decontamination(spark, odd):
    item = prose(3, 15)
    words = item.split()
    texts = [*odd, (20, "Head, " + item.upper() + "! tail"), (21, " ".join(words[:9])), (22, "a b-c d"), (22, "a b-c d")]
    items = spark.createDataFrame([(7, item), (8, "B c"), (9, None), (10, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs(spark, texts), items).collect()}
    assert got[20] == (17, 15, ["7"]) and got[21] == (9, 0, []) and got[22] == (4, 2, ["8"]) and got[1] == (0, 0, [])
    assert decontaminate.contamination(docs(spark, texts), items).count() == len(texts)
    assert decontaminate.contamination(docs(spark, []), items).count() == 0
    near = decontaminate.matches(docs(spark, [(1, "b x c")]), spark.createDataFrame([(1, "b c")], "item_id long, text string"), slop=2).first()
    assert [h.kind for h in near.hits] == ["proximity"]


def test_chat_round_trip(spark):
    hard = "<|im_end|>\n<|im_start|>assistant &amp; &lt;| <"
    turns = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (1, 4, "user", "bye"), (2, 0, "us\ner", hard), (None, None, None, None), (3, 0, "assistant", "😀é"), (3, 0, "assistant", "😀é")]
    examples = chat.format_examples(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, no int"))
    rows = examples.withColumn("t", chat.parse_turns(examples.formatted)).withColumn("y", chat.trained_text(examples.formatted, examples.loss_start, examples.loss_end)).orderBy("conv_id", "example").collect()
    last = {r.conv_id: [(t.role, t.text) for t in r.t] for r in rows if r.is_last}
    assert last[1] == [("system", hard), ("user", ""), ("assistant", hard), ("assistant", ""), ("user", "bye")]
    assert last[2] == [("us\ner", hard)] and last[None] == [("", "")]
    assert [r.y for r in rows if r.conv_id == 1] == [hard, "", ""] and [r.y for r in rows if r.conv_id == 3] == ["😀é", "😀é"]


def test_chat_of_nothing(spark):
    examples = chat.format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert examples.count() == 0


def test_shards(spark, odd):
    texts = [*odd, *((50 + i, "same") for i in range(40)), *((200 + i, f"own {i}") for i in range(37))]
    rows = sharding.shard(docs(spark, texts), shards=4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r.slot)
    assert len(rows) == len(texts) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert sharding.shard(docs(spark, [])).count() == 0


def test_main_text(spark):
    page = lambda i: f"<html><title>T</title><body><header>Site</header><div id=top>Welcome</div><div class='side-bar sidebar'>x</div><div class=c><h2>Title {i}<p>Body &lt;{i}&gt;\n text<p>More&nbsp;{i}</div><div>Terms</div></body>"
    rows = [(i, "https://a.test/" + str(i), page(i), "h") for i in range(5)] + [(9, None, None, ""), (10, "x", "", ""), (11, "https://b.test", "<article><h1>A</h1><p>b<script>c</script><div class=comments>d</div></article>", "")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[3] == "Title 3\nBody <3> text\nMore 3" and got[9] == got[10] == "" and got[11] == "A\nb"


def test_lattice_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((30, 64))
    x = np.vstack([base, base[:20] + 0.1 * r.standard_normal((20, 64)), base[:3], base[0] + 0.1 * r.standard_normal((60, 64))])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, base[0].tolist(), None), (504, [1.0, None], 1)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    got = {v.vec_id: v for v in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found, true = sum(got[i].n_links for i in range(len(x))), link.sum()
    assert true and true * 0.99 <= found <= true
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))


def test_quality(spark):
    good = [(i, prose(i, 60)) for i in range(120)]
    bad = [(1000 + i, "BUY!! NOW!! " * 20 + prose(i, 5).upper()) for i in range(60)]
    foul = [(2000 + i, prose(i, 40) + " idiot " + prose(i + 1, 20)) for i in range(60)]
    all_ = docs(spark, [*good, *bad, *foul, (5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, int(i < 1000 or i >= 2000), int(i >= 2000), "z") for i, _ in [*good, *bad, *foul] if i % 3], "doc_id long, quality int, toxic int, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(all_, labels).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in [*bad, *foul]) and len(kept) == 242
    assert quality.judge(docs(spark, []), labels).count() == 0
    assert all(r.kept for r in quality.judge(docs(spark, good[:3]), labels.limit(0)).collect())


def test_very_long_text_is_judged_whole(spark):
    labelled = [(i, prose(i, 60) if i % 2 else "BUY!! NOW!! " * 20) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in labelled], "doc_id long, quality int, toxic int")
    long = prose(900, 60_000)
    told = quality.judge(docs(spark, [*labelled, (900, long), (901, "BUY!! NOW!! " * 50_000), (901, "BUY!! NOW!! " * 50_000)]), labels)
    rows = {r.doc_id: r for r in told.collect()}
    assert rows[900].kept and not rows[901].kept and told.count() == 123
    assert rows[900].text == long and rows[900].row == "r"  # columns that clash come back as they were


def test_site_shifts_against_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        sites = [(r.choice(["a", "b", "c", None]), r.choice(["x", "y", None])) for _ in range(1 + 8 * seed)]
        rows = [(h, p, r.gauss(2 if h == "a" else -1, 1.5)) for h, p in sites for _ in range(r.randint(1, 12))]
        good = lambda q: 1 / (1 + np.exp(-q))
        n, total = len(rows), sum(good(q) for *_, q in rows)
        mean = min(max(total / n, 1e-4), 1 - 1e-4)
        of = lambda keep: [good(q) for h, p, q in rows if keep(h, p)]
        hosts = {h for h, *_ in rows}
        between = sum(sum(of(lambda x, _: x == h)) ** 2 / len(of(lambda x, _: x == h)) for h in hosts) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
        shrink = min(max(mean * (1 - mean) / between - 1, quality.LEAST_SHRINK), quality.MOST_SHRINK) if between > 0 else quality.MOST_SHRINK
        expected = {}
        for h, p in {(h, p) for h, p, _ in rows}:
            host, path = of(lambda x, _: x == h), of(lambda x, y: (x, y) == (h, p))
            share = (sum(path) + shrink * (sum(host) + shrink * mean) / (len(host) + shrink)) / (len(path) + shrink)
            shift = np.log(share / (1 - share)) - np.log(mean / (1 - mean))
            expected[h, p] = min(max(shift, -quality.SITE_LIMIT), quality.SITE_LIMIT)
        got = {(x.host, x.path): x.site_shift for x in quality.site_shifts(spark.createDataFrame(rows, "host string, path string, _q double")).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_secret_ledger(spark):
    key = "é AKIA" + "A" * 16 + " password = hunter2x token: ab " + "0a" * 12
    texts = docs(spark, [(1, key), (2, key), (2, key), (3, None), (4, ""), (5, "token=ab")])
    found, ledger = secrets.scan(texts)
    rows = {r.doc_id: [(f.kind, f.start, f.stop) for f in r.findings] for r in found.collect()}
    assert rows[1] == rows[2] == [("access", 2, 22), ("assign", 23, 42), ("hex", 53, 77)] and rows[3] == rows[4] == rows[5] == []
    assert found.count() == 6 and ledger.count() == 3
    again, grown = secrets.scan(docs(spark, [(9, key), (10, "secret: abcdefgh")]), ledger)
    assert grown.count() == 4 and {r.doc_id: len(r.findings) for r in again.collect()} == {9: 3, 10: 1}
    text = found.where("doc_id = 1").join(texts, "doc_id").select(secrets.redact(texts.text, found.findings).alias("x")).first()["x"]
    assert text == "é [access] [assign] token: ab [hex]"


def test_only_unseen_rule_versions_are_scanned(spark):
    texts = docs(spark, [(1, "AKIA" + "B" * 16 + " token: abcdefgh"), (2, "AKIA" + "C" * 40), (3, None)])
    _, ledger = secrets.scan(texts)
    changed = tuple(dataclasses.replace(r, keep="30") if r.kind == "access" else r for r in secrets.RULES)
    found, grown = secrets.scan(texts, ledger, changed)
    new = grown.subtract(ledger)
    assert new.count() == 3 and all(r.rules == [changed[1].version] for r in new.collect())
    assert {r.doc_id: [f.kind for f in r.findings] for r in found.collect()} == {1: ["assign"], 2: ["access"], 3: []}
    same, still = secrets.scan(texts, grown, changed)
    assert still.count() == grown.count() and sorted(same.collect()) == sorted(found.collect())
    former, _ = secrets.scan(texts, grown)
    assert {r.doc_id: [f.kind for f in r.findings] for r in former.collect()} == {1: ["access", "assign"], 2: ["access"], 3: []}


def test_secrets_against_brute_force(spark):
    r = random.Random(5)
    bits = ["token=", "abc", "é𝄞", "0a" * 12, "f" * 24, "AKIA" + "Z9" * 8, " ", "PassWord\" : 'qwerty12", "api_key:", "\n", "AKIA", "secret =  ", "x1y2z3"]
    texts = ["".join(r.choice(bits) for _ in range(n)) for n in (0, 1, 5, 40, 400, 6000)] + ["token=abcdef " * 256, "token=abcdef " * 257]
    whole = {
        "assign": (r"(?:[Pp]ass[Ww]ord|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    found, _ = secrets.scan(docs(spark, list(enumerate(texts))))
    for row in found.collect():
        want = sorted((m.start(), no, k, m.end()) for no, (k, (p, ok)) in enumerate(whole.items()) for m in re.finditer(p, texts[row.doc_id]) if ok(m))
        assert [(f.start, f.no, f.kind, f.stop) for f in row.findings if f.no < 3] == want
    none, ledger = secrets.scan(docs(spark, []))
    assert none.count() == ledger.count() == 0


def pages_of(spark, sources, host="a.test"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string")


def test_constant_blocks_in_articles(spark):
    box = "<div class=box><p>We may earn money from links.</div>"
    pages = pages_of(spark, [f"<body><article><h1>Title {i}</h1><p>Story {i}</p>{box}</article></body>" for i in range(6)])
    for sent in (wrapper.SENT_BYTES, 0):
        assert {r.page_id: r.text for r in wrapper.extract(pages, sent).collect()} == {i: f"Title {i}\nStory {i}" for i in range(6)}
    same = [f"<article><h1>One</h1><p>Same story.</p><p>Version {i}</p></article>" for i in range(2)]
    assert {r.text for r in wrapper.extract(pages_of(spark, same)).collect()} == {f"One\nSame story.\nVersion {i}" for i in range(2)}


def test_chance_equals_stay(spark):
    sources = [f"<body><div class=top>Menu</div><div class=c><p>{'Sold out.' if i < 9 else f'Left: {i}'}</p><p>Item {i}</p></div></body>" for i in range(30)]
    got = {r.page_id: r.text for r in wrapper.extract(pages_of(spark, sources)).collect()}
    assert got == {i: f"{'Sold out.' if i < 9 else f'Left: {i}'}\nItem {i}" for i in range(30)}


def test_content_roots_are_whole(spark):
    beside = "<body><main><div><p>Story one.</p><p>Story two.</p></div><article class=card>Teaser</article></main></body>"
    parts = "<body><div class=c><article>Part one is long.</article><article>Two</article><aside><article>Else</article></aside></div></body>"
    empty = "<body><article></article><div>Body text</div></body>"
    rows = [(i, f"https://h{i}.test/", s) for i, s in enumerate([beside, parts, empty])]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Story one.\nStory two.\nTeaser", 1: "Part one is long.\nTwo", 2: "Body text"}


def test_each_layout_has_its_template(spark):
    kinds = ("blog", "product", "forum", "wiki")
    page = lambda i: f"<body><div class={kinds[i % 4]}><div class=head>{kinds[i % 4]} menu</div><div class=text><p>Own text {i}</p></div></div></body>"
    got = {r.page_id: r.text for r in wrapper.extract(pages_of(spark, [page(i) for i in range(24)])).collect()}
    assert got == {i: f"Own text {i}" for i in range(24)}
    shared = [f"<body><div class={kinds[i % 4]}>Own text {i}</div><div class=c>{kinds[i % 4]} box</div></body>" for i in range(24)]
    assert {r.page_id: r.text for r in wrapper.extract(pages_of(spark, shared), 0).collect()} == {i: f"Own text {i}" for i in range(24)}


def cut_by_hand(pairs):
    return sum(a[0] == b[0] and a[1] != b[1] for i, a in enumerate(pairs) for b in pairs[:i])


def test_shards_under_skew(spark):
    texts = ["hot"] * 800 + [f"ten {i // 10}" for i in range(450)] + [f"pair {i // 2}" for i in range(300)] + [f"own {i}" for i in range(850)]
    random.Random(4).shuffle(texts)
    rows = sharding.shard(docs(spark, list(enumerate(texts)))).collect()
    on, slots = {}, {}
    for r in rows:
        on.setdefault(texts[r.doc_id], []).append(r["shard"])
        slots.setdefault(r["shard"], []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(150)) for s in slots.values())
    pairs = [(texts[r.doc_id], r["shard"]) for r in rows]
    told = sharding.cut_edges(spark.createDataFrame(pairs, "g string, shard int"), ["g"]).first()
    # only the group larger than a shard is cut, into five whole shards and what is left
    assert len(set(on.pop("hot"))) == 6 and told.cut == cut_by_hand(pairs) == (800**2 - 5 * 150**2 - 50**2) // 2
    assert told.links == 800 * 799 // 2 + 45 * 45 + 150
    assert all(len(set(s)) == 1 for s in on.values())


def test_shards_without_unlinked_documents(spark):
    texts = [f"group {i // 5}" for i in range(400)]
    rows = sharding.shard(docs(spark, list(enumerate(texts)))).collect()
    assert len({(texts[r.doc_id], r["shard"]) for r in rows}) == 80 and sorted(r.slot for r in rows if r["shard"] == 3) == list(range(25))


def test_shards_go_through_rounds_at_every_size(spark, monkeypatch):
    turns, own = [], sharding._round
    monkeypatch.setattr(sharding, "_round", lambda left, room, turn: turns.append(turn) or own(left, room, turn))
    r = random.Random(9)
    for n, kinds in ((40, 10), (300, 60)):
        texts = [f"t{r.randrange(kinds)}" for _ in range(n)]
        pairs = [(texts[x.doc_id], x["shard"]) for x in sharding.shard(docs(spark, list(enumerate(texts))), shards=4).collect()]
        assert turns and turns[0] == 0 and max(map(len, [[p for p in pairs if p[1] == s] for s in range(4)])) <= -(-n // 4)
        told = sharding.cut_edges(spark.createDataFrame(pairs, "g string, shard int"), ["g"]).first()
        first = cut_by_hand([(t, i % 4) for i, t in enumerate(texts)])
        assert told.cut == cut_by_hand(pairs) < first / 5  # what dealing in turn cuts
        turns.clear()
    assert tuple(sharding.cut_edges(spark.createDataFrame([], "g string, shard int"), ["g"]).first()) == (0, 0)


def test_null_ids_leave_links_alone(spark):
    words = prose(11, 60).split()
    near = " ".join([*words[:-1], "other"])
    rows = docs(spark, [(None, " ".join(words)), (1, " ".join(words)), (2, near)]).coalesce(1)
    assert {(r.doc_id, r.component_id) for r in jaccard.similar(rows, 4, 85).collect()} == {(None, None), (1, 1), (2, 1)}


def test_pipeline_keeps_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    leak = prose(21, 30)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    a, b, c, d = (prose(30 + i, 60) for i in range(4))
    key = prose(40, 40) + " AKIA" + "A" * 16
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, a), (None, leak), (None, key), (8, None), (8, "")]
    base = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    store = Store(spark, "t")
    one, at = base, str(tmp_path)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    one = store.put(cp.good_documents(spark, base, at), "good")
    assert texts(one) == sorted(rows, key=str)
    one = store.put(cp.one_of_each(spark, one, at), "one")
    left = [(None, b), (5, c), (5, d), (7, a), (None, leak), (None, key), (8, None), (8, "")]
    assert texts(one) == sorted(left, key=str)
    one = store.put(cp.decontaminated(spark, one, at), "clean")
    left.remove((None, leak))
    assert texts(one) == sorted(left, key=str)
    one = store.put(cp.without_secrets(spark, one, at), "safe")
    assert texts(one) == sorted(((i, t.replace("AKIA" + "A" * 16, "[access]") if t else t) for i, t in left), key=str)
    packed = cp.packed(spark, one, at).collect()
    assert sum(r.piece == 0 for r in packed) == len(left)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = spark.createDataFrame([(1, prose(3, 40), None, None, None)], schema)
    assert cp.decontaminated(spark, one, str(tmp_path)).collect() == one.collect()  # no item, no contamination
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
