"""Filter interaction, source divergence and language-model scores against brute force, on odd inputs."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("crawlsight.llm")

from crawlsight.llm import chat, decontaminate, divergence, filter_audit, language_model, lattice, wrapper  # noqa: E402
from crawlsight.llm.texts import letter_terms, spaced_words, text_blocks  # noqa: E402
from crawlsight.llm.transducer import Transducer  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, part string, n int, failed string, range int, survivors int, block string, value long"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "p", 1, "f", 2, 3, "b", 4) for r in rows], DOCS).repartition(3)


def texts(seed, n):
    r = random.Random(seed)
    words = ["Ärger", "ab", "abc", "ABD", "b", "x1y", "naïve", "漢字", "😀", "to", "a#b", "Z", "don't"]
    space = [" ", "\t", "\n", "\x0b", "\r\n", "  ", "\x1f", "\xa0"]
    return [("" if r.random() < 0.3 else " ") + "".join(w for _ in range(r.randint(0, 30)) for w in (r.choice(words) + r.choice("abc") * r.randint(0, 1), r.choice(space))) for _ in range(n)]


def test_blocks_and_words():
    rows = texts(3, 200) + ["", "x" * 500, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 40]), pa.array(range(i, i + len(rows[i : i + 40])))], names=["text", "no"]) for i in range(0, len(rows), 40)]
    for kind in (None, lambda b: np.array(b["no"].to_pylist()) % 3):
        seen = defaultdict(list)
        for k, t in text_blocks(iter(batches), "text", 300, kind):
            lengths = [len(x.encode()) for x in t["text"].to_pylist()]
            assert sum(lengths) <= 300 or len([n for n in lengths if n]) == 1
            seen[k] += t["no"].to_pylist()
        assert sorted(x for v in seen.values() for x in v) == list(range(len(rows))) and all(v == sorted(v) for v in seen.values())
    array = pa.array(["skipped", *rows]).slice(1)
    got, sizes = spaced_words(array)
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t in rows]
    assert got.to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    for kind in (pa.string(), pa.large_string()):
        terms, of = letter_terms(array.cast(kind))
        want = [(w, i) for i, t in enumerate(rows) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))]
        assert list(zip([t.decode() for t in terms.to_pylist()], of.tolist(), strict=True)) == want
    assert len(letter_terms(pa.array([], pa.string()))[0]) == 0


def test_transducer_is_minimal_and_orders_terms():
    for seed in range(80):
        r = random.Random(seed)
        terms = sorted({"".join(r.choice("abé") for _ in range(r.randint(0 if seed % 5 == 0 else 1, 6))).encode() for _ in range(r.randint(0, 40))})
        t = Transducer.unpack(Transducer.build(terms).pack())
        futures = {frozenset(x[len(p) :] for x in terms if x.startswith(p)) for x in terms for p in (x[:i] for i in range(len(x) + 1))} | {frozenset(terms)}
        assert len(t.final) == len(futures)
        asked = [*terms, b"", b"zz", *(x + b"a" for x in terms), *(x[:-1] for x in terms)]
        ends = np.cumsum([len(x) for x in asked])
        got = t.ordinals(np.frombuffer(b"".join(asked), "u1"), np.concatenate([[0], ends[:-1]]), ends)
        assert got.tolist() == [terms.index(x) if x in terms else -1 for x in asked]
        assert [t.term(i) for i in range(len(terms))] == terms


def test_carry_save_counts():
    r = np.random.default_rng(1)
    planes, words = filter_audit.Planes(), r.integers(0, 2**32, 10_007, dtype="u4")
    for part in np.split(words, [1, 2, 5, 4000]):
        planes.add(part)
    planes.add(words[:0])
    assert planes.counts().tolist() == [int((words >> np.uint32(i) & np.uint32(1)).sum()) for i in range(32)]
    table = filter_audit.survival_words()
    assert all((int(table[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def audit_brute(rows, labels):
    first, out = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        judged.append((lang or "", failed, any(d == i is not None and q == 1 for d, q, _ in labels), any(d == i is not None and x == 1 for d, _, x in labels)))
    for part in {x[0] for x in judged}:
        mine = [x for x in judged if x[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                share[f] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(x[1][f] and any(x[1][g] for g in order[:k]) for x in mine),
                            sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        for row in out:
            if row[0] == part:
                row.append(share[row[1][row[2] - 1]])
    return {tuple(r) for r in out}


def test_filter_audit(spark):
    r = random.Random(5)
    long = " ".join(f"w{i}" for i in range(300))
    pool = [*texts(8, 20), None, "", long, long + " #", long.upper(), "a b " * 300, " \t", long]
    rows = [(r.choice([i, i, i, 3, None]), r.choice(pool), r.choice(["en", "de", None, ""]), "s") for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 150, 2), 3, 4, 4, None]]
    got = filter_audit.audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    told = [tuple(x) for x in got.collect()]
    assert len(told) == 3 * 600 and set(told) == audit_brute(rows, labels)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), none).count() == 0
    assert set(map(tuple, filter_audit.audit(docs(spark, rows[:3]), none).collect())) == audit_brute(rows[:3], [])


def divergence_brute(rows, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for lang in {r[2] or "" for r in rows}:
        mine = [(r[3] or "", words(r[1])) for r in rows if (r[2] or "") == lang]
        df = Counter(w for _, x in mine for w in set(x))
        kept = {w for w, n in df.items() if n >= 3}
        counts = defaultdict(Counter)
        for s, x in mine:
            counts[s].update(w for w in x if w in kept)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        of, whole = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in of:
            f = lambda a, b: (a - b) * (a - b) // b
            pairs = sorted(((-sum(f(of[s][w], of[o][w]) for w in kept), o.encode()) for o in of if o != s))
            terms = sorted((-f(of[s][w], whole[w]), w.encode()) for w in kept if counts[s][w] and of[s][w] > whole[w])[:top]
            for part, x in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize("shape", [{}, {"size": 2, "block": 400, "together": 2, "at_once": 2}])
def test_divergence(spark, shape):
    r = random.Random(2)
    rows = [(i % 70, t, r.choice(["en", "en", "de", None]), r.choice(["a", "b", "b", "ç", None, "d"])) for i, t in enumerate(texts(4, 90))]
    rows += [(1, None, "en", "empty"), (2, "", "xx", "one"), (3, "only once", "xx", "two"), (4, "abc", "fr", "alone")] + [rows[0]] * 3
    got = divergence.divergence(docs(spark, rows), **shape)
    assert sorted(map(tuple, got.collect())) == divergence_brute(rows)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0
    assert divergence.divergence(docs(spark, [(1, None, None, None)])).count() == 0


def test_exact_probabilities_beyond_64_bits():
    n, total, v = 30_000_000_000_000, 70_000_000_000_001, 7
    assert divergence._probability(np.array([0, n]), total, v).tolist() == [1 + 10**9 // (total + v), 1 + 10**9 * (n + 1) // (total + v)]


def model_brute(rows):
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    told = [(i, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [" end"]) for i, t, *_ in rows]
    grams = lambda x: list(zip([" start", *x[:-1]], x, strict=True))
    all_, rest = (Counter(), Counter(), Counter()), (Counter(), Counter(), Counter())
    deleted = Counter()
    for i, x in told:
        if part(i) % 7 == 2:
            continue
        own = part(i) // 7 % language_model.PARTS == 0
        deleted.update(grams(x) if own else ())
        for one, two, before in (all_,) if own else (all_, rest):
            one.update(x)
            two.update(grams(x))
            before.update([" start", *x[:-1]])
    total, v = sum(all_[0].values()), len(all_[0])
    def estimates(counts, a, b):
        n = counts[2][a]
        return (1 + int(math.log2(n)) if n else 0), counts[1][a, b] / max(n, 1), counts[0][b] / max(sum(counts[0].values()), 1)
    weights = prior = [(0, 1 / 2, 1 / 2)] + [(1 / 3, 1 / 3, 1 / 3)] * 63
    facts = [(*estimates(rest, a, b), n) for (a, b), n in deleted.items()]
    for _ in range(language_model.ROUNDS):
        sums = [[0.0] * 3 for _ in range(64)]
        for level, two, one, n in facts:
            mix = [w * e for w, e in zip(weights[level], (two, one, 1 / (v + 1)), strict=True)]
            for j in range(3):
                sums[level][j] += n * mix[j] / sum(mix)
        new = [tuple((s[j] + p[j]) / (sum(s) + 1) for j in range(3)) for s, p in zip(sums, prior, strict=True)]
        change = max(abs(x - y) for a, b in zip(new, weights, strict=True) for x, y in zip(a, b, strict=True))
        weights = new
        if change < 1e-6:
            break
    def chance(a, b):
        level, two, one = estimates(all_, a, b)
        return sum(w * e for w, e in zip(weights[level], (two, one, 1 / (v + 1)), strict=True))
    out = []
    for i, x in told:
        base = sum(math.log10((all_[0][w] + 1) / (total + v + 1)) for w in x)
        out.append((i, part(i) % 7 == 2, len(x), sum(all_[0][w] > 0 for w in x), total, base, sum(math.log10(chance(a, b)) for a, b in grams(x))))
    return out, chance, [*all_[0], "never seen"], all_[2]


@pytest.mark.parametrize("block_bytes", [language_model.BLOCK, 2000])
def test_language_model(spark, block_bytes):
    rows = [(i if i % 17 else None, t, "en", "s") for i, t in enumerate(texts(6, 260))] + [(5, None, "en", "s"), (6, "", None, None), (6, "", None, None), (9, "same same " * 3000, "en", "s")]
    want, chance, known, contexts = model_brute(rows)
    got = language_model.train_and_score(docs(spark, rows), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    told = sorted(map(tuple, got.collect()), key=key)
    assert len(told) == len(rows)
    for a, b in zip(told, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    for v in (next(iter(contexts)), "never seen"):  # probabilities of all words after a context sum to one
        assert sum(chance(v, w) for w in known) == pytest.approx(1)
    held = [r for r in told if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_language_model_of_little(spark):
    assert language_model.train_and_score(docs(spark, [])).count() == 0
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = language_model.train_and_score(docs(spark, [(i, "a b", "en", "s") for i in ids])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 2


def test_lattice_with_repeated_ids_of_other_vectors(spark):
    r = np.random.default_rng(3)
    near = lambda v: (v + 0.01 * r.normal(size=len(v))).tolist()
    a, b, *others = r.normal(size=(12, 16))
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (10, near(a), 1), (11, near(b), 1), (12, near(b), 2), (3, a.tolist(), 1), (None, a.tolist(), 1)]
    rows += [(int(r.integers(20, 30)), near(others[int(r.integers(0, 10))]), int(r.integers(1, 3))) for _ in range(60)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links, component = Counter(), {i: i for i, _, _ in rows if i is not None}
    n = [sum(x[0] is not None and y[0] is not None and i != j and x[2] == y[2] and unit[i] @ unit[j] >= 0.98 for j, y in enumerate(rows)) for i, x in enumerate(rows)]
    for (i, _, _), k in zip(rows, n, strict=True):
        links[i] = max(links[i], k)
    for _ in rows:
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if x[0] is not None and y[0] is not None and x[2] == y[2] and unit[i] @ unit[j] >= 0.98:
                    component[x[0]] = component[y[0]] = min(component[x[0]], component[y[0]])
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(i, links[i], component[i]) for i in component} | {(None, 0, None)}
    assert links[11] == 1


def tree(r, depth, tags="ab", words="xyz"):
    """A random tree as nested lists: a string is a text."""
    if depth == 0 or r.random() < 0.3:
        return r.choice(words)
    return (r.choice(tags), [tree(r, depth - 1, tags, words) for _ in range(r.randint(0, 3))])


def made(spec, texts):
    if isinstance(spec, str):
        texts.append(spec)
        return wrapper.Tree("", spec, len(texts) - 1)
    t = wrapper.Tree(spec[0])
    t.kids = [made(k, texts) for k in spec[1]]
    t.close()
    return t


def matched(a, b):
    """Simple tree matching by its definition, every ordered pairing tried."""
    if isinstance(a, str) or isinstance(b, str):
        return (1 + (a == b)) if isinstance(a, str) and isinstance(b, str) else 0
    if a[0] != b[0]:
        return 0

    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        w = matched(a[1][i], b[1][j])
        return max(best(i + 1, j), best(i, j + 1), w + best(i + 1, j + 1) if w else 0)

    return 1 + best(0, 0)


def test_matcher_against_brute_force(monkeypatch):
    for pairs, seeds in ((wrapper.PAIRS, 300), (0, 60)):
        monkeypatch.setattr(wrapper, "PAIRS", pairs)
        for seed in range(seeds):
            r = random.Random(seed)
            specs = [("root", [tree(r, 3) for _ in range(r.randint(0, 3))]) for _ in range(2)]
            texts = [[], []]
            a, b = (made(s, t) for s, t in zip(specs, texts, strict=True))
            found = wrapper.Matcher().blocks(a, b)
            assert all((texts[0][i] == texts[1][j]) == same for i, j, same in found)
            order = sorted(found)
            assert [j for _, j, _ in order] == sorted(j for _, j, _ in found) and len({i for i, _, _ in found}) == len(found)
            if pairs:
                assert wrapper.Matcher().weight(a, b) == matched(*specs)


def site(spark, sources, host="one"):
    return spark.createDataFrame([(i, f"https://{host}.test/{i}", s, "x") for i, s in enumerate(sources)], "page_id long, url string, html string, host string")


def test_only_an_alignment_finds_the_template(spark):
    names = ["red", "blue", "green", "gold", "grey", "pink"]
    # no two pages have a path in common below the body, and one more element shifts every second page
    page = lambda i: f"<body><div class={names[i]}x><p class={names[i]}>Always here</p>{'<table><tr><td>extra ' + names[i] + '</table>' if i % 2 else ''}<ul class={names[i]}><li>Own line {i}</li><li>Same line</li></ul></div></body>"
    pages = site(spark, [page(i) for i in range(6)])
    got = {r.page_id: r.text for r in wrapper.extract(pages).collect()}
    assert got == {i: (f"extra {names[i]}\n" if i % 2 else "") + f"Own line {i}" for i in range(6)}
    assert {r.page_id: r.text for r in wrapper.extract(pages, 0).collect()} == got  # references joined, not sent


def test_forms_soft_words_and_bad_markup(spark):
    prose = " ".join(f"word{i}" for i in range(70))
    cases = {
        "<body><nav>menu</nav><form method=post action=x><input type=hidden><div><h1>Title</h1><p>The whole page stands in a form.</p></div></form></body>": "Title\nThe whole page stands in a form.",
        "<body><form><label>Name</label><input></form><p>More text than the form has, by far.</p></body>": "More text than the form has, by far.",
        f"<body><div class=social-policy><p>{prose}</p></div><section id=related-work><p>{prose}</p></section></body>": f"{prose}\n{prose}",
        f"<body><p>Text</p><div class=related><p><a href=x>{prose}</a></p></div><div class=comments><p>{prose}</p></div></body>": "Text",
        "<p>Before</p>" + '<a "' * 250_000: "Before\n" + '<a "' * 249_999 + '<a "', "<p>a</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>b": "a\ndeep\nb",
        "<p>x" + "<!" * 300_000: "x" + "<!" * 300_000, "": "", "plain &amp; text": "plain & text",
    }
    rows = [(i, f"https://h{i}.test/", s, "x") for i, s in enumerate(cases)] + [(99, None, None, "x")]
    began = time.time()
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ""
    assert time.time() - began < 120


def test_a_template_counts_each_source_once(spark):
    page = lambda i: f"<body><article><p>Shared words of two versions</p><p>Own {i}</p></article></body>"
    got = {r.page_id: r.text for r in wrapper.extract(site(spark, [page(0)] * 40 + [page(1)])).collect()}
    assert got[0] == "Shared words of two versions\nOwn 0" and got[40] == "Shared words of two versions\nOwn 1"
    got = {r.page_id: r.text for r in wrapper.extract(site(spark, [page(i) for i in range(12)] + [page(0)])).collect()}
    assert got == {i: f"Own {i % 12}" for i in range(13)}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_contamination_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = ["ab", "Ab", "c", "dé", "e1", "漢"]
    say = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ". ", "\n", "-"]) for _ in range(n))
    items = [(i, say(r.choice([0, 2, 3, 10, 12, 14]))) for i in range(12)] + [(20, None), (21, "..."), (3, say(11)), (22, "ab c")]
    rows = [(i % 30, say(r.randint(0, 40)), "en", "s") for i in range(40)] + [(50, None, "en", "s"), (51, "", None, None), (52, say(900), "en", "s")]
    rows += [(60 + i, say(5) + (items[i][1] or "") + say(3), "en", "s") for i in range(12)] + [rows[0]] * 2
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {(tuple(w[k : k + 10]), str(i)) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))}
    want = []
    for i, t, *_ in rows:
        w = words(t)
        hit, named = set(), set()
        for x, item in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    named.add(item)
        want.append((i, len(w), len(hit), len(named), sorted(named), bool(hit)))
    found = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, list(x.item_ids or []), x.contaminated) for x in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[5] for x in want) > 10


def test_chat_against_brute_force(spark):
    r = random.Random(12)
    pieces = ["<|im_end|>", "<|im_start|>assistant", "\n", "&lt;", "&#10;", "&amp;", "a", "é", "😀", "<", "|>", ""]
    say = lambda: None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "system", "user\nx"]), say(), "x") for c in (*range(30), None) for t in range(r.randint(1, 7))]
    got = {x.conv_id: x for x in chat.conversation_digests(chat.format_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, no string"))).collect()}
    for c in {t[0] for t in turns}:
        mine = [(role, text or "") for k, _, role, text, _ in turns if k == c]
        loss = "".join(t for role, t in mine if role == "assistant")
        x = got[c]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (x.n_turns, x.turns_sha256) == (len(mine), digest("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), digest(loss))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_examples(empty)).count() == 0
