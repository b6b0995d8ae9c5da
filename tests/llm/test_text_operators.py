"""Operators on texts against brute force, over the odd cases of conftest."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callgrid.llm import bpe, linking, lines, minhash, packing, pii, quality, shard, substrings, tiff
from callgrid.llm.components import components
from callgrid.llm.shingles import OnePermutation, band_keys

PATH = P.path("byte_bpe_50k.tiktoken")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_near_duplicates(docs, none):
    got = rows(minhash.near_duplicates(docs))
    assert len(got) == docs.count()
    items = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = []
    for _, t in items:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(items)))
    for _ in items:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = []
    for i, (d, _) in enumerate(items):
        ids = [items[j][0] for j in range(len(items)) if label[j] == label[i] and items[j][0] is not None]
        first = min(ids) if ids else None
        want.append((d, len(sets[i]), first, d is not None and d == first))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(want)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_stars_miss_no_link(spark):
    """Members of a bucket that are alike though neither is like the bucket's first."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)] + [" ".join(base[:200] + [f"v{k}"] + base[201:280] + [f"tail{j}" for j in range(30)] + ["end"] * k) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(df))}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_quality(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in rows(quality.verdicts(docs))}
    for r in docs.collect():
        t = r["text"] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(win)
        covered = {j for i, x in enumerate(win) if many[x] > 1 for j in range(i, i + 8)}
        ls = [x for x in t.split("\n") if re.sub("[\x20\x09-\x0d]+", "", x)]
        g = got[r["doc_id"], len(w)]
        assert (g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.verdicts(none).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_lines_are_counted_by_document(spark):
    """Rows that repeat a doc_id are one document."""
    line = "a line that stands in many rows but few documents"
    data = [(1 + i % 2, f"{line}\n" + " ".join(f"own{i}w{j}" for j in range(30)), "a") for i in range(60)]
    got = rows(quality.verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")))
    assert len(got) == 60 and all(r["kept"] and r["n_left"] == r["n_words"] for r in got)


def test_boilerplate_lines(spark):
    """A line in many documents of a host goes from all but the first, and what is left too short is rejected."""
    line = "this very line stands in each page of the host and says nothing at all about what the page is for or why anyone reads it"
    data = [(i, line, "a") for i in range(25)] + [(100 + i, line + "\n" + " ".join(f"own{i}w{j}" for j in range(40)), "a") for i in range(5)] + [(200, line, "b")]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")))}
    assert got[0] and not any(got[i] for i in range(1, 25)) and all(got[100 + i] for i in range(5)) and got[200]


def test_boilerplate_lines_go(spark):
    """Kept documents lose the line that others of their host repeat: not the first one, not in other hosts, not from a null host's."""
    line, own = "Terms  of use apply to this page", lambda i: " ".join(f"own{i}w{j}" for j in range(40))
    data = [(i, f"{own(i)}\n\n {line.lower() if i % 2 else line}\nlast {own(i + 1000)}", "a") for i in range(25)] + [(100, f"{own(100)}\n{line}", "b"), (101, f"{own(101)}\n{line}", None), (5, own(5), "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in rows(quality.keep_good(df)))
    assert got == Counter((i, f"{own(i)}\n\nlast {own(i + 1000)}" if 0 < i < 25 and s == "a" else t, s) for i, t, s in data)


def _base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, docs, none):
    odd = ["a@b.c.d@e.f x", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "x@" + "a." * 3000 + "b", "+1" * 500, "é🙂 a@b.co 🙂 +44 20 7946 0958.", "a" * 20_000 + "@b.c", "0" * 5000]
    for df in (docs.dropDuplicates(["doc_id"]), spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in rows(pii.report(df)):
            want = _base_spans(text[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    assert pii.report(none).count() == 0 and pii.masked(docs).count() == docs.count()


def test_pii_discovers(spark):
    """A context that introduces known phones also introduces a number that no plain pattern matches; elsewhere numbers stay."""
    data = [f"please call me on +1 (555) 010-{1000 + i} today" for i in range(12)] + ["please call me on 0555-0199 today", "the year 2024-1999 was fine"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(pii.report(df))}
    assert got[12] == "phone:18:27" and got[13] == ""
    assert {r["doc_id"]: r["text"] for r in rows(pii.masked(df))}[12] == "please call me on <phone> today"


def _discovered(items):
    """The spans of pii.report by plain loops: base spans, contexts, the pattern graph and its scores."""
    base, met = [], []
    for i, (_, t) in enumerate(items):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in _base_spans(t).split(",") if x)]
        base.append(spans)
        seeds = [(k, a, b, max([e for q, _, e in _hits(t) if q == k and e <= a], default=0)) for k, a, b in spans]
        others, last = [], 0
        for m in regex.finditer(pii.IDENTIFIER, t):
            if len(re.sub("[^0-9]", "", m[0])) >= pii.MIN_DIGITS and not any(a < m.end() and m.start() < b for _, a, b in spans):
                others.append((None, m.start(), m.end(), last))
            last = m.end()
        for k, a, b, since in seeds + others:
            left = t[max(since, a - pii.LEFT_CHARS) : a].lower()
            found = re.search(r"(?:^|\s)((?:\S+\s+){%d}\S+\s*)$" % (pii.LEFT - 1), left, re.ASCII)
            if found and (shape := re.sub(r"\s+", " ", re.sub("[0-9]+", "0", found[1]), flags=re.ASCII)):
                met.append((i, k, a, b, t[a:b], shape))
    kinds = {}
    for _, k, *_, v, p in met:
        kinds[p, v] = max(kinds.get((p, v)) or "", k or "") or None
    graph = {}
    for p in {p for p, _ in kinds}:
        count = Counter(k for (q, _), k in kinds.items() if q == p and k)
        if sum(count.values()) >= pii.SUPPORT:
            best = max(pii.KINDS, key=lambda k: (count[k], -pii.KINDS.index(k)))
            for (q, v), k in kinds.items():
                if q == p:
                    graph[p, v] = (best, float(k == best))
    score = {}
    for (_, v), (k, seed) in graph.items():
        score[v, k] = max(score.get((v, k), 0.0), seed)
    for _ in range(pii.ROUNDS):
        of = {}
        for (p, v), (k, seed) in graph.items():
            of.setdefault((p, k), []).append(max(seed, score[v, k]))
        confidence = {x: sum(y) / len(y) for x, y in of.items()}
        rest, sure = {}, {}
        for (p, v), (k, seed) in graph.items():
            c = confidence[p, k]
            rest[v, k] = rest.get((v, k), 1.0) * (1 - min(0.999, c if c >= pii.CONFIDENCE / 2 else 0.0))
            sure[v, k] = max(sure.get((v, k), 0.0), seed)
        score = {x: max(sure[x], 1 - rest[x]) for x in rest}
    out = []
    for i, spans in enumerate(base):
        new = set()
        for j, k, a, b, v, p in met:
            if j == i and k is None and (p, v) in graph:
                kind, seed = graph[p, v]
                if seed == 0 and confidence[p, kind] >= pii.CONFIDENCE and score[v, kind] >= pii.ACCEPT:
                    new.add((kind, a, b))
        every = sorted({*spans} | new, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
    return out


def _hits(t):
    """All matches of the plain patterns, failing ones too: what stands left of a match begins after the one before."""
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        yield from ((k, m.start(), m.end()) for m in re.finditer(p, t))


def test_pii_against_loops(spark):
    r = random.Random(4)
    seeds = [lambda: f"+44 20 {r.randrange(1000, 9999)} {r.randrange(1000, 9999)}", lambda: f"u{r.randrange(99999)}@mail.example", lambda: f"10.{r.randrange(255)}.{r.randrange(255)}.7"]
    odd = [lambda: f"0{r.randrange(1000, 9999)}/{r.randrange(100, 999)}", lambda: f"ID{r.randrange(5000, 5040)}", lambda: f"{r.randrange(1990, 2030)}"]
    leads = ["please call", "write to", "the host", "in the year", "our ref", "see page"]
    items = []
    for i in range(250):
        parts = []
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(leads))
            parts.append(f"Then {leads[k]} {seeds[k]() if k < 3 and r.random() < 0.93 else r.choice(odd)()}")
        items.append((i, r.choice([". ", " and ", "\n"]).join(parts)))
    got = {x["doc_id"]: x["spans"] for x in rows(pii.report(spark.createDataFrame(items, "doc_id long, text string")))}
    want = _discovered(items)
    assert [got[i] for i, _ in items] == want and sum(len(a) != len(_base_spans(t)) for a, (_, t) in zip(want, items, strict=True)) > 5


def test_pii_of_a_long_text(spark):
    """A hundred thousand numbers in one text, some of them personal: time grows with the text, not with its square."""
    parts = [f"+44 20 7946 {i % 10_000:04d} x" if i % 50 == 0 else f"n{i:06d}" for i in range(100_000)]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = rows(pii.report(df))
    assert r["base_sha256"] == hashlib.sha256(_base_spans(text).encode()).hexdigest() and r["n_phone"] == 2000
    (m,) = rows(pii.masked(df))
    assert m["text"].count("<phone>") == 2000 and "+44" not in m["text"] and m["text"].count("n0") > 1000


def _removed(items):
    """doc_id, words, words gone and digest of the rest, by comparing all windows of 50 words."""
    first = {}
    for d, w in items:
        for i in range(len(w) - 49):
            if d is not None:
                x = tuple(w[i : i + 50])
                first[x] = min(d, first.get(x, d))
    want = Counter()
    for d, w in items:
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return want


def _removed_by(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substrings.removed(df)))


def test_substrings(docs, none):
    assert _removed_by(docs) == _removed([(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()])
    assert substrings.removed(none).count() == 0 and substrings.without_repeats(docs).count() == docs.count()
    clash = docs.withColumns({"__id": F.lit(1), "mark": F.lit(2), "row": F.lit(3), "__left": F.lit(4)})
    assert substrings.without_repeats(clash).columns == clash.columns


def _passages(seed):
    """Documents put together from passages of all lengths, whole, cut and with words changed; loops of few words among them."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([20, 49, 50, 51, 80, 150, 300]))] for _ in range(12)] + [["a", "b", "c"] * 60, ["x"] * 120]
    out = []
    for i in range(60):
        w = [f"own{i}_{j}" for j in range(r.randrange(30))]
        for _ in range(r.randint(1, 4)):
            p = list(r.choice(base))
            a = r.randrange(len(p)) if r.random() < 0.4 else 0
            p = p[a : a + r.randint(1, len(p))] if r.random() < 0.4 else p[a:]
            for _ in range(r.choice([0, 0, 1, 3])):
                p[r.randrange(len(p))] = f"new{r.randrange(1000)}"
            w += p
        out.append((r.randrange(40), " ".join(w)))
    return out


def test_substrings_of_passages(spark):
    items = _passages(1)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert _removed_by(df) == _removed([(d, t.encode().split()) for d, t in items])


def test_ranges_are_read_at_their_source(spark):
    """Ranges of equal graph coordinates but other words, as after a clash of hashes, have other digests."""
    items = [(0, " ".join(f"a{i}" for i in range(120))), (1, " ".join(f"b{i}" for i in range(120))), (2, " ".join(f"a{i}" for i in range(120)))]
    kind = "doc_id long, mark long, text string, where array<struct<start: long, count: long>>, cuts array<long>"
    df = spark.createDataFrame([(d, d, t, [(0, 71)], [0, 40, 105]) for d, t in items], kind)
    found = {}
    for r in rows(substrings._verified(df, 50, 16)):
        found.setdefault((r["start"], r["count"]), {})[r["doc_id"]] = bytes(r["digest"])
    assert sorted(found) == [(0, 6), (6, 34), (40, 31)] and all(x[0] == x[2] != x[1] for x in found.values())


def test_packing(docs, none):
    got = rows(packing.pack(docs, P.path("word_bpe_49k.json")))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            want[r["doc_id"], s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_plan_fills():
    counts = {1000: 7, 3096: 3, 2048: 5, 1: 10, 4096: 2}
    p = packing.plan(counts)
    assert {x: sum(b - a for y, a, b, *_ in p if y == x) for x in counts} == counts
    assert packing.fullest([(7, 2), (5, 3)], 19) == {7: 2, 5: 1} and packing.fullest([(5, 1)], 4) == {}


def test_byte_bpe(docs, none):
    ranks = bpe.ByteBpe(PATH, P.PATTERN).ranks
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = np.array(e.encode_ordinary(r["text"] or ""), "<u4")
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    got = rows(bpe.digests(docs, PATH, P.PATTERN))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.digests(none, PATH, P.PATTERN).count() == 0
    back = rows(bpe.decode_ids(bpe.encode_texts(docs, PATH, P.PATTERN), PATH, P.PATTERN))
    assert Counter(bytes(r["bytes"]) for r in back) == Counter((r["text"] or "").encode() for r in docs.collect())


def test_caches_when_full(monkeypatch):
    """Full caches change nothing but speed."""
    monkeypatch.setattr(packing, "MOST_WORDS", 8)
    w = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    w.words, w.rest, w.parts = packing.WordTable(4), packing.WordTable(4), bpe.Cache(3)
    texts = [" ".join(f"word{chr(97 + (i * k) % 26)}x{chr(97 + k)}." for i in range(20)) for k in range(1, 9)]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_asks_its_cache_for_new_pieces_only():
    """Learning words costs what these words cost, not a walk over all pieces that are kept."""

    class Asked(bpe.Cache):
        def __iter__(self):
            raise AssertionError("the whole cache was walked")

    w = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    w.parts = Asked(100)
    texts = ["one two, three", "two three four's 5", "one one"]
    want = [np.array(x.ids, "<u4").tobytes() for x in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [w.encode([t])[0] for t in texts] == want == w.encode(texts)


def test_shards(docs, none):
    got = rows(shard.shard(docs, 4))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard.shard(none).count() == 0


def test_shards_even(spark):
    """A third of all rows are copies of one text; sizes are near equal all the same."""
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 20) ELSE repeat(concat('t', id), 10 + cast(id % 17 as int)) END AS text")
    sizes = Counter()
    for r in rows(shard.shard(df, 24)):
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 24 + 2 * 400


def test_tiff(docs, none):
    got = {r["doc_id"]: r for r in rows(tiff.store_texts(docs.dropDuplicates(["doc_id"])))}
    for r in docs.dropDuplicates(["doc_id"]).collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert tiff.store_texts(none).count() == 0


def test_tiff_of_other_writers():
    """Files put together by hand: no compression, PackBits and deflate with a predictor, both byte orders."""
    def file(order, fields, data):
        head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data))
        entry = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0) if v < 65536 else struct.pack(order + "HHII", tag, 4, 1, v)
        return head + data + struct.pack(order + "H", len(fields)) + b"".join(entry(t, fields[t]) for t in sorted(fields)) + struct.pack(order + "I", 0)

    base = {256: 3, 257: 2, 258: 8, 262: 1, 273: 8, 277: 1, 278: 2}
    want = [[7, 7, 7], [1, 2, 3]]
    for order in "<>":
        plain, packed = bytes([7, 7, 7, 1, 2, 3]), bytes([0xFE, 7, 2, 1, 2, 3])
        flat = zlib.compress(bytes([7, 0, 0, 1, 1, 1]))
        for data, more in ((plain, {259: 1}), (packed, {259: 32773}), (flat, {259: 8, 317: 2})):
            (page,) = tiff.read_pages(file(order, base | more | {279: len(data)}, data))
            assert page.data[:, :, 0].tolist() == want


def test_tiff_digest(spark):
    """What the query says of the stored form: its size and digest, the pages read back, and equal rows for equal texts."""
    texts = ["", "a" * 576, "b" * 577, "a" * 576]
    got = sorted(rows(tiff.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))), key=lambda r: r["doc_id"])
    for r, t in zip(got, texts, strict=True):
        payload = t.encode().ljust(max(1, -(-len(t) // 576)) * 576, b"\xff")
        blob = tiff.store(payload)
        back = b"".join(p.data.tobytes() for p in tiff.read_pages(blob))
        assert back == payload and (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())
        seen = [sum(64 * q <= x < 64 * q + 64 for x in payload) for q in range(4)]
        assert r["feature"].endswith(f"min={min(payload)};max={max(payload)};mean={sum(payload) * 1000 // len(payload)};quarters={','.join(map(str, seen))}")
    assert {k: v for k, v in got[1].items() if k != "doc_id"} == {k: v for k, v in got[3].items() if k != "doc_id"}


def test_tiff_forms(spark):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 4, (70, 33), np.uint8) * 60, np.zeros((5, 300), np.uint8), rng.integers(0, 255, (40, 50, 3), np.uint8)]
    for compression in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for tile, predictor, order in ((0, 1, "<"), (16, 2, ">"), (0, 2, ">"), (32, 1, "<")):
            back = list(tiff.read_pages(tiff.write_pages(pages, compression, predictor, tile, 7, order)))
            assert all((b.data == (p if p.ndim == 3 else p[:, :, None])).all() for b, p in zip(back, pages, strict=True))
    long = bytes(rng.integers(0, 200, 60_000, np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(long)) == long and tiff.unpack_bits(tiff.pack_bits(long)) == long
    files = spark.createDataFrame([(1, tiff.write_pages(pages)), (2, b"no tiff"), (3, None), (4, b"II*\0\x08\0\0\0\xff\xff")], "file long, blob binary")
    got = rows(tiff.decode_tiff(files, "file", "blob"))
    assert sorted((r["file"], r["page"] if r["page"] is not None else -1) for r in got) == [(1, 0), (1, 1), (1, 2), (2, -1), (3, -1), (4, -1)]


def _lines_left(items):
    """What line dedup removes, by comparing every line with every other: {place in items: places of lines}."""
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x.strip(" \t\n\x0b\x0c\r").lower())
    texts = [[norm(x) for x in (t or "").split("\n")] for _, t in items]
    every = sorted({x for t in texts for x in t} - {""})
    k = lines.SHINGLE
    sets = {x: {x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in every}
    label = {x: x for x in every}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(every):
        for b in every[:i]:
            if 100 * len(sets[a] & sets[b]) >= lines.PERCENT * len(sets[a] | sets[b]):
                label[max(top(a), top(b))] = min(top(a), top(b))
    seen, gone = set(), {}
    for i in sorted(range(len(items)), key=lambda i: (items[i][0] is None, items[i][0] or 0)):
        gone[i] = []
        for at, x in enumerate(texts[i]):
            if x and top(x) in seen:
                gone[i].append(at)
            elif x:
                seen.add(top(x))
    return gone, texts


def test_lines(docs, none):
    """Which lines go, of each document with a doc_id of its own; texts keep all others."""
    items = [(r["doc_id"], r["text"]) for r in docs.dropDuplicates(["doc_id"]).collect()]
    own = docs.sparkSession.createDataFrame(items, "doc_id long, text string")
    want, texts = _lines_left(items)
    got = {r["doc_id"]: r for r in rows(lines.line_report(own))}
    left = {r["doc_id"]: r["text"] for r in rows(lines.without_duplicate_lines(own))}
    for i, (d, t) in enumerate(items):
        assert (got[d]["n_lines"], got[d]["n_removed"], got[d]["removed"]) == (sum(map(bool, texts[i])), len(want[i]), want[i])
        assert left[d] == (None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in want[i]))
    # rows that repeat doc_id and text are one document, and all rows and columns stay
    assert len(rows(lines.line_report(docs))) == docs.count() == lines.without_duplicate_lines(docs).count()
    clash = own.withColumns({"__id": F.lit(1), "__mark": F.lit(2), "gone": F.lit(3), "mark": F.lit(4)})
    assert sorted(lines.without_duplicate_lines(clash).collect(), key=str) == sorted((Row(**{c: r[c] if c != "text" else left[r["doc_id"]] for c in clash.columns}) for r in clash.collect()), key=str)
    assert lines.line_report(none).count() == 0 and lines.without_duplicate_lines(none).count() == 0


def test_lines_of_random_edits(spark):
    """Lines with edits of all sizes, some like two others that are not alike: the components are those of all pairs."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(8, 40))) for _ in range(40)]
    made = []
    for _ in range(400):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(words)
        made.append(" ".join(w))
    items = [(i, "\n".join(made[i * 4 : i * 4 + 4])) for i in range(100)]
    want, _ = _lines_left(items)
    got = {x["doc_id"]: x["removed"] for x in rows(lines.line_report(spark.createDataFrame(items, "doc_id long, text string")))}
    assert got == want


def test_chunks_of_a_bucket(spark, monkeypatch):
    """Buckets dealt in chunks give the same components."""
    items = [(i, f"the common start of a line that everyone writes and number{i // 2:03d} to tell it from the others of its kind") for i in range(40)]
    items += [(100 + i, "the common start of a line that everyone writes and another ending of it altogether, " + "abcdefghij"[i % 10] * 3) for i in range(40)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    want, _ = _lines_left(items)
    monkeypatch.setattr(linking, "CHUNK_ROWS", 3)
    got = {x["doc_id"]: x["removed"] for x in rows(lines.line_report(df))}
    assert got == {items[i][0]: want[i] for i in want}


def test_components(spark):
    """A path, a star, a clique's worth of repeats, a node linked with itself, and no links."""
    r = random.Random(2)
    path = list(range(1000, 1200))
    r.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(5, x) for x in range(6, 60)] + [(2, 2), (-3, 7), (70, 71), (71, 70)]
    got = {x["node"]: x["label"] for x in rows(components(spark.createDataFrame(links, "a long, b long").repartition(5)))}
    want = {x: 1000 for x in path} | {x: -3 for x in [-3, *range(5, 60)]} | {2: 2, 70: 70, 71: 70}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_at_the_threshold_share_a_band():
    """Planted pairs from similarity 0.85 to 0.88: none is missed."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 20_000:
        a = " ".join(r.choices(words, k=r.randint(16, 60)))
        b = list(a)
        for _ in range(r.randint(1, 3)):
            b[r.randrange(len(b))] = "#"
        b = "".join(b)
        s, t = ({x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in (a, b))
        if 0.85 <= len(s & t) / len(s | t) < 0.88:
            pairs.append((a.encode(), b.encode()))
    oph = OnePermutation(lines.BANDS * lines.ROWS)
    a, b = (band_keys(lines.line_sketches([p[i] for p in pairs], oph), lines.BANDS, lines.ROWS) for i in (0, 1))
    assert (a == b).any(axis=1).all()


def test_keep_good_judges_each_row(spark):
    """A bad row beside a good one of its doc_id, null ids among them, goes; equal rows go together."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(None, "short one"), (None, "x " * 40), (None, good), (7, "bad"), (7, good + " seven"), (8, "bad"), (7, "bad"), (7, good + " seven"), (9, None)]
    df = spark.createDataFrame([(i, t, "src" if i != 8 else None) for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in quality.keep_good(df).collect())
    assert got == Counter({(None, good): 1, (7, good + " seven"): 2})


def test_line_sets_by_one_sort(monkeypatch):
    """Sets and lines are as by plain Python, without the hash table of np.unique(), which took most of the time of a comparison."""

    def refused(*_, **__):
        raise AssertionError("np.unique() was called")

    monkeypatch.setattr(np, "unique", refused)
    r = random.Random(5)
    texts = ["", "  ", "a", "one line \n\n two", *("".join(r.choice(s) for _ in range(r.randrange(80))) for s in ("ab \n", "ab \t\n\r\x0b\x0cé", "aÄ🙂İ \x1c\x85\n", "ab\n") for _ in range(200))]
    k, seen = lines.SHINGLE, {}
    for t in texts:
        got = lines.normalised_lines(t)
        assert got == [b" ".join(x.split()) for x in t.lower().encode().split(b"\n")]
        for line in filter(None, got):
            x, s = line.decode(), lines.line_set(line)
            parts = {x[i : i + k] for i in range(max(1, len(x) - k + 1))}
            assert s.tolist() == sorted(set(s.tolist())) and len(s) == len(parts)
            seen.setdefault(frozenset(parts), s.tolist())
            assert seen[frozenset(parts)] == s.tolist()
    oph = OnePermutation(lines.BANDS * lines.ROWS)
    each = sorted({x for t in texts for x in lines.normalised_lines(t) if x})
    together = lines.line_sketches(each, oph)
    for x, row in zip(each, together, strict=True):
        values, full = oph.sketch(lines.line_set(x))
        assert row.tolist() == oph.densify(values[None], full[None])[0].tolist()
    assert len(lines.line_set(b"")) == 0
