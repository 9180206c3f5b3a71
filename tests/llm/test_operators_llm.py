"""Each operator against a brute-force version on small tables with the awkward cases in them."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import decontaminate, html_text, katz, line_dedup, ngram_join, packing, repeats, token_frames, toxicity, transport_stream
from gridloom.llm.common import WordwiseTokenizer, scratch

RNG = random.Random(5)
WORDS = ["the", "of", "and"] + ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = prose(70)
LONG = "\n".join(prose(30) for _ in range(60))
TEXTS = [
    (0, prose(80) + "\n" + PASSAGE + "\n" + prose(40)), (1, None), (2, ""), (3, PASSAGE), (4, PASSAGE), (5, LONG), (6, LONG + " tail"), (7, " \t\n "), (8, "one two"), (9, "one two"), (None, "no id " + prose(30)),
    (11, "Ünïcödé É x " * 30), (12, "a" * 700), (13, "\n".join([prose(9)] * 3)), (14, prose(50)), (14, prose(50)), (15, PASSAGE.upper()), (2**60 + 1, prose(20)), (16, "<|endoftext|> it's 12\t3\r\n  x"),
]
SCHEMA = "doc_id long, text string, score double, raws int"  # with names that operators use themselves


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 1) for i, t in TEXTS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


def encoded(t, name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(name))
    return [lib.encode(x or "", add_special_tokens=False).ids for x in t]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_tokenizer_is_the_library(name, kind):
    odd = ["a  b", "<|ENDOFTEXT|> a", "x<|startoftext|>y", "a,b 12.5% don't (z)", "   x", "x \n y", "\n\n\nq\n", "a\tb", "a\x1cb", "x　y", "tail ", "a|b | c", "\0 a"]
    texts = [t or "" for _, t in TEXTS] + odd
    w = WordwiseTokenizer(public_tokenizers.path(name), kind)
    for _ in range(2):  # the second time from what it kept
        assert [list(x) for x in w.encode(texts)] == encoded(texts, name)
        w.rest()


def test_token_frames(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_frames.write(docs, scratch(spark, "t"), path, frame_ids=100)
    got = [tuple(r) for r in token_frames.read(spark, manifest).orderBy("start").collect()]
    ids = {(i, t): x + [2] for (i, t), x in zip(TEXTS, encoded([t for _, t in TEXTS], "word_bpe_49k.json"))}
    assert [r[0] for r in got] == sorted((i for i, _ in TEXTS), key=key)
    start = 0
    for i, s, n, crc in got:
        assert s == start and (n, crc) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, _), x in ids.items() if k == i}
        start += n
    some = token_frames.read(spark, manifest, {3, 5}, with_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in some} == {3: ids[3, PASSAGE], 5: ids[5, LONG]}
    assert token_frames.write(nothing, scratch(spark, "t"), path) == [] and token_frames.read(spark, []).count() == 0


def test_token_frames_notice_damage(spark, tmp_path):
    w = token_frames.ShardWriter(f"file://{tmp_path}/a/x.zst", np.dtype("<u2"), 2, 1, 10)
    for i in range(3):
        w.add(i, np.arange(25))
    w.close()
    r = token_frames.ShardReader(f"file://{tmp_path}/a/x.zst")
    assert list(r.tokens(1)) == list(range(25)) and len(r.table) == 3 * 3 + 2
    raw = bytearray((tmp_path / "a" / "x.zst").read_bytes())
    raw[int(r.offset[1]) + 12] ^= 255
    (tmp_path / "a" / "y.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or ours
        token_frames.ShardReader(f"file://{tmp_path}/a/y.zst").tokens(0)


def test_packing(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, capacity=128, with_ids=True).collect()
    want = Counter()
    for (i, _), x in zip(TEXTS, encoded([t for _, t in TEXTS], "byte_bpe_50k.json")):
        x = x + [2]
        first = (len(x) - 1) % 128 + 1
        for k, a in enumerate([0, *range(first, len(x), 128)]):
            part = x[a : a + (first if k == 0 else 128)]
            want[i, k, a, tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 128
    assert packing.pack_documents(nothing, path).count() == 0


def test_packing_is_near_the_bound():
    counts = np.bincount(np.random.default_rng(1).integers(1, 256, 20_000), minlength=257)
    plan = packing.pack(counts, 256)
    used = np.zeros(257, int)
    for c, n in plan:
        assert sum(c) <= 256
        for l in c:
            used[l] += n
    bound = (counts * np.arange(257)).sum() / 256
    assert (used == counts).all() and sum(n for _, n in plan) <= bound * 1.01


def test_toxicity(spark, nothing):
    bad = ["grumbo", "flarnish", "zubbel", "morkadi", "vextun"]
    rows, labels = [], []
    for i in range(900):
        words = prose(RNG.randint(5, 60)).split()
        toxic = i % 8 == 0
        for _ in range(3 * toxic):
            words.insert(RNG.randrange(len(words)), RNG.choice(bad) + RNG.choice(["", "a", "en"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(9001, None), (9002, ""), (None, "grumbo flarnish"), (9003, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i]["score"] >= 0.3) == (i % 8 == 0) for i in held) / len(held) > 0.97
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values()) and got[9001]["score"] == got[9002]["score"]
    untrained = toxicity.fit(docs, known.limit(0))
    assert {round(r["score"], 9) for r in toxicity.score(docs, untrained).collect()} == {0.5}
    assert toxicity.score(nothing, untrained).count() == 0
    found = toxicity.segments(np.array([1.0, -0.5, 2, -9, 3, -1, -1, 1]))
    assert found == [(0, 2, 2.5), (4, 4, 3.0), (7, 7, 1.0)]


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_repeats(spark, docs, nothing):
    want = Counter((i, *r) for (i, _), r in zip(TEXTS, brute_repeats([t for _, t in TEXTS], 200)))
    got = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == want
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_with_edits(spark, seed):
    rng = random.Random(seed)
    base = [prose(150) for _ in range(6)]
    texts = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        a, b = sorted(rng.sample(range(len(w)), 2))
        texts.append(" ".join(w[a:b]) + rng.choice(["", " end", "z" * 250]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, chunk_bytes=5000).collect()}
    assert [got[i] for i in range(60)] == brute_repeats(texts, 200)


def test_repeats_shared_in_overlapping_pairs(spark):
    """a+b in one document, b+c in another (and c+d in a third), all of them joined in the last: no window over a join is more than these pairs."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for k in range(150):
        parts = [text(rng.randint(40, 320)) for _ in range(3 + k % 2)]
        texts += [text(300) + x + y + text(300) for x, y in zip(parts, parts[1:])]
        texts.append(text(300) + "".join(parts) + text(300))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, chunk_bytes=100_000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_transport_stream(spark, docs, nothing):
    got = transport_stream.describe(transport_stream.parse_media(transport_stream.to_media(docs))).collect()
    want = Counter()
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()}) == 1
    assert transport_stream.parse_media(transport_stream.to_media(nothing)).count() == 0


def test_transport_stream_notices_damage():
    payload = bytes(RNG.randrange(256) for _ in range(192 * 700))
    m = transport_stream.mux(payload)
    s = transport_stream.demux(m)
    assert s.payload == payload and s.pts[:2] == [0, 3000] and s.continuity_errors == 0 and len(s.random_access) == 2
    p = 188
    assert transport_stream.demux(m[: 5 * p] + m[4 * p : 5 * p] + m[5 * p :]).payload == payload  # a packet sent twice
    assert transport_stream.demux(m[: 5 * p] + m[6 * p :]).continuity_errors == 1
    with pytest.raises(ValueError, match="sync"):
        transport_stream.demux(b"x" + m[1:])
    with pytest.raises(ValueError, match="checksum"):
        transport_stream.demux(m[:12] + b"\xff" + m[13:])


def brute_lines(texts, min_chars=20):
    seen, out = {}, []
    for n, (i, t) in sorted(enumerate(texts), key=lambda x: key(x[1][0])):
        lines = [(k, l) for k, l in enumerate((t or "").split("\n")) if l.strip()]
        gone = set()
        for a in range(len(lines)):
            size = 0
            for b in range(a, len(lines)):
                size += len(lines[b][1])
                if size >= min_chars:
                    w = tuple(l for _, l in lines[a : b + 1])
                    if w in seen and seen[w] != (n, a):
                        gone.update(range(a, b + 1))
                    seen.setdefault(w, (n, a))
                    break
        raws = {lines[a][0] for a in gone}
        kept = "" if raws and len(raws) == len(lines) else "\n".join(l for k, l in enumerate((t or "").split("\n")) if k not in raws)
        out.append((i, len(lines), len(raws), kept))
    return Counter(out)


def test_line_dedup(spark, nothing):
    texts = [(1, "alpha beta gamma delta eps\nshort\n\nunique one here we go on"), (2, "short\nalpha beta gamma delta eps"), (3, "x\ny\nz tiny lines but many\n"), (4, "q\nx\ny\nz tiny lines but many"), (5, None), (6, ""), (7, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl\nm\nn\no\np\nq\nr\ns\nt\nu\nv"), (8, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl\nm\nn\no\np\nq\nr\ns\nt\nu\nw"), (9, "same same same same same\n" * 3), (None, "alpha beta gamma delta eps")]
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got) == brute_lines(texts)
    assert {r["doc_id"]: len(r["runs"]) for r in got}[8] == 1
    assert line_dedup.dedup_lines(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a line that is long enough to count"), (1, "a line that is long enough to count")], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.dedup_lines(twice).collect()] == [0, 0]


def test_line_suffix_order_and_intervals(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join(rng.choice("ab" if rng.random() < 0.8 else "cdefgh ") for _ in range(rng.randrange(30)))) for i in range(12)]
    texts += [(i + 100, texts[i][1]) for i in range(3)] + [(200, "a\n" * 40), (201, "a\n" * 30 + "b"), (None, "a\n" * 7)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lines, _, n = line_dedup.placed(line_dedup.keyed(docs), 1)
    rounds = line_dedup.suffix_order(lines, n, 64)
    got = sorted((r["place"], r["at"]) for _, t in rounds for r in t.where("not open").collect())
    name = {r["at"]: (r["name"], r["rest"]) for r in lines.collect()}
    suffix = {at: [name[k][0] for k in range(at, at + rest)] for at, (_, rest) in name.items()}
    whole = sorted(suffix, key=lambda at: (suffix[at], at))  # an end stands below all lines, ends in order of documents
    assert got == list(enumerate(whole)) and len(rounds) > 5
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b]))) for a, b in zip(whole, whole[1:])]
    assert sorted(map(tuple, line_dedup.common_prefixes(rounds).collect())) == [(k, v) for k, v in enumerate(shared) if v]
    best = {}  # blocks of 16 places, so intervals go on over several
    for r in line_dedup.longest_earlier(rounds[0][1].sparkSession.createDataFrame([(k, at, 0, 1) for k, at in got], "place long, at long, i int, w int"), line_dedup.common_prefixes(rounds), 16).collect():
        best[r["at"]] = max(best.get(r["at"], 0), r["best"])
    lcp = {}
    for k, at in enumerate(whole):
        least = 1 << 30
        for j in range(k - 1, -1, -1):
            least = min(least, shared[j + 1])
            lcp[at, whole[j]] = lcp[whole[j], at] = least
    assert best == {at: max((lcp[at, other] for other in whole if other < at), default=0) for at in whole}
    for min_chars in (1, 20):
        kept = line_dedup.dedup_lines(docs, min_chars, places=64).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in kept) == brute_lines(texts, min_chars)


def test_line_dedup_takes_short_ends_of_runs(spark):
    run = "a line that is long enough to count\nend"
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, run), (2, "own\n" + run), (3, "end")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in got} == {1: (0, run), 2: (2, "own"), 3: (0, "end")}


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingle_set(t) for _, t in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up = [up[b] if u == up[a] else u for u in up]
    return [(i, len(s), min((texts[k][0] for k in range(len(texts)) if up[k] == up[n] and s and texts[k][0] is not None), default=i)) for n, ((i, _), s) in enumerate(zip(texts, sets))]


def test_ngram_join(spark, docs, nothing):
    assert Counter(map(tuple, ngram_join.join_components(docs).collect())) == Counter(brute_components(TEXTS))
    assert ngram_join.join_components(nothing).count() == 0
    rng, base, texts = random.Random(9), [prose(60) for _ in range(4)], []
    for i in range(70):  # chains of near copies around the threshold
        w = base[i % 4].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append((i, " ".join(w) + rng.choice(["", " " + PASSAGE])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(map(tuple, ngram_join.join_components(df).collect())) == Counter(brute_components(texts))


def test_katz(spark, docs, nothing):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for _, t in TEXTS]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in TEXTS]
    uni = Counter(w for t, ok in zip(tokens, train) if ok for w in t)
    bi = Counter(p for t, ok in zip(tokens, train) if ok for p in zip(["\t", *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    of = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])
    du, db = katz.discounts(of(uni)), katz.discounts(of(bi))
    p1 = {w: du[min(c, katz.K + 1)] * c / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p(h, w):
        if h not in after:
            return p1.get(w, unknown)
        c_h, kept = sum(after[h].values()), sum(db[min(c, katz.K + 1)] * c for c in after[h].values())
        c_h += kept > c_h * (1 - 1e-9)
        if w in after[h]:
            return db[min(after[h][w], katz.K + 1)] * after[h][w] / c_h
        return (1 - kept / c_h) / (1 - sum(p1[x] for x in after[h])) * p1.get(w, unknown)

    for h in ("the", "\t", "one"):
        assert math.isclose(sum(p(h, w) for w in uni) + p(h, "never seen"), 1, abs_tol=1e-9)
    want = Counter()
    for (i, _), t, ok in zip(TEXTS, tokens, train):
        base, full = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["\t", *t[:-1]], t))
        want[i, not ok, len(t), sum(w in uni for w in t), n, round(base, 6), round(full, 6)] += 1
    got = katz.score(docs, tokens=200).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert katz.score(nothing).count() == 0


def test_decontaminate(spark, nothing):
    items = [(i, prose(RNG.randint(12, 50))) for i in range(30)] + [(90, None), (91, "too short"), (92, "")]
    rows, planted = [(1000, None), (1001, ""), (1002, prose(300)), (1003, "too short")], set()
    for k in range(120):
        i, t = items[k % 30]
        w = t.split()
        for _ in range(len(w) // 10 if k % 2 else 0):
            a = RNG.randrange(len(w))
            w[a : a + 1] = RNG.choice([[], ["changed"], [w[a], "more"]])
        rows.append((k, prose(RNG.randrange(60)) + "\n" + " ".join(w).title() + " " + prose(20)))
        planted.add((k, i))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench, block=7).collect()}
    assert len(got & planted) / len(planted) >= 0.95 and not got - planted
    clean = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert {1000, 1001, 1002, 1003} <= clean and len(clean) <= 4 + 0.05 * len(planted)
    assert decontaminate.contaminations(nothing, bench).count() == 0 and decontaminate.contaminations(docs, bench.limit(0)).count() == 0
    item, text = np.array([1, 2, 3, 4, 5]), np.array([9, 9, 1, 2, 7, 4, 5, 9])
    assert decontaminate.edit_window(item, text, 2) == (1, 2, 7) and decontaminate.edit_window(item, text, 0) is None


def test_decontaminate_at_a_documents_start():
    """Items that lost up to a fifth of their words where a document begins, in a batch of several documents."""
    items = [(i, prose(20 + 3 * i)) for i in range(20)]
    plan = decontaminate.Plan(items, 0.2, 12, 4, 8)
    texts, planted = [], {}
    for i, t in items:
        w = t.split()
        for cut in range(1, len(w) // 5 + 1):
            texts += ["", prose(30), prose(3)][len(texts) % 3 :][:1]
            planted[len(texts)] = (i, cut)
            texts.append(" ".join(w[cut:]) + " " + prose(20))
    got = {}
    for d, i, first, n, distance in decontaminate.matches(texts, plan):
        got[d, i] = (first, distance)
    assert {d for d, _ in got} <= set(planted)
    found = [d for d, (i, cut) in planted.items() if (d, i) in got]
    assert len(found) >= 0.95 * len(planted)
    assert all(got[d, planted[d][0]][1] <= planted[d][1] for d in found)


PAGE = """<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><div class="top-menu"><a href="/a">Home</a> <a href="/b">News</a></div>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><{0}{1}><h1>Head &amp; more</h1><p>{2}<br>{3}<p>{4} &eacute;<aside>see also</aside><div class="comments"><p>nice post</p></div></{0}>
<form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    pages = [(i, PAGE.format(*(("article", "") if i % 2 else ("div", ' class="entry-content"')), prose(40) + ".", prose(30) + ".", prose(50) + ".")) for i in range(60)]
    odd = [(100, None), (101, ""), (102, "<p>"), (103, "<!-- only"), (104, "<script>x"), (105, pages[3][1])]
    df = spark.createDataFrame([(i, h, "u", None if i == 5 else f"http://h/{i}") for i, h in pages + odd], "page_id long, html string, text string, url string")
    out = html_text.extract(df, html_text.fit(df))
    assert out.columns == ["page_id", "url", "text", "n_blocks"] and html_text.extract(df.drop("url"), None).where("url is not null").count() == 0
    found = out.collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert all(r["url"] == (None if r["page_id"] == 5 else f"http://h/{r['page_id']}") for r in found)
    right = 0
    for i, h in pages:
        body = re.search(r"</h1><p>(.*?)<br>(.*?)<p>(.*?) &eacute;", h, re.S)
        right += got[i] == f"Head & more\n{body[1]} {body[2]}\n{body[3]} é"
    assert right == len(pages)
    assert [got[i] for i in (100, 101, 102, 103, 104)] == [""] * 5 and got[105] == got[3]
    assert html_text.fit(df.limit(0)) is None and html_text.extract(df.limit(0), None).count() == 0


def test_html_query_returns_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    pages, out = spark.read.parquet(f"{sf}/pages.parquet"), html_text.op2_html_text(spark, sf)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted((r["page_id"], r["url"]) for r in out.collect()) == sorted((r["page_id"], r["url"]) for r in pages.select("page_id", "url").collect())


def test_html_decoding_is_consistent():
    """The decoding against every assignment of in, out and mixed to small trees."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 7))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        page = html_text.Page(["div"] * n, parent, [0] * n, [(i, "w" * int(rng.integers(1, 90)), 0) for i in range(n) if rng.random() < 0.7])
        p = rng.uniform(0.02, 0.98, n)
        own = np.zeros(n)
        for i, text, _ in page.runs:
            own[i] += len(text)
        weight = np.where(own > 0, 0.5 + np.log1p(own), 0.5)
        gain = np.column_stack([weight * np.log(1 - p), weight * np.log(p), np.where(own > 0, weight * np.maximum(np.log(p), np.log(1 - p)), 0.0) - 1.0])
        best = None
        for states in itertools.product((0, 1, 2), repeat=n):
            if any(s == 2 and i not in parent for i, s in enumerate(states)) or any(i and states[parent[i]] != 2 and states[parent[i]] != s for i, s in enumerate(states)):
                continue
            total = sum(gain[i, s] for i, s in enumerate(states))
            best = max(best or (total, states), (total, states))
        kept = html_text.keep_nodes(page, p)
        assert kept.tolist() == [s == 1 or (s == 2 and p[i] >= 0.5) for i, s in enumerate(best[1])]


@pytest.mark.parametrize("unit, tail", [("<a x", ""), ('<a ">"', "'"), ("<b><div></b>", ""), ("<i></q>", ""), ("<div><li></li>", ""), ("<!x", ""), ("<", ""), ("<a<", "")])
def test_html_of_malformed_pages_takes_linear_time(unit, tail):
    begin = time.monotonic()
    html_text.parse("<p>kept</p>" + unit * (1_000_000 // len(unit)) + tail)
    assert time.monotonic() - begin < 20  # minutes to hours where time grows with the square


def test_html_after_an_open_quote():
    page = html_text.parse("<p>one <b>two</b><p class='x>three</p><p>four")
    assert [text for _, text, _ in page.runs] == ["one two", "three", "four"]
