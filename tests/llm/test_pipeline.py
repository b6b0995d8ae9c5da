"""The stages, each on what the one before kept, against plain loops over the same documents."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from test_text_operators import _discovered, _lines_left
from tokenizers import Tokenizer

from callgrid.llm import minhash, quality


def _good(items):
    """Quality rules: (doc_id, text, source) of the documents that pass, without the lines above the limit."""
    bare = lambda x: " ".join(w for w in re.split("[\x20\x09-\x0d]+", x) if w)
    homes = {}
    for d, t, s in items:
        for x in {bare(x).lower() for x in (t or "").split("\n")} - {""}:
            homes.setdefault((s, x), set()).add(d)
    first = {k: min(v) for k, v in homes.items() if len(v) > quality.LINE_DOCS}
    out = []
    for d, t, s in items:
        w = bare(t or "").split()
        many = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if many[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        gone = [first.get((s, bare(x).lower()), d) != d for x in (t or "").split("\n")]
        lost = sum(len(bare(x).split()) for x, g in zip((t or "").split("\n"), gone, strict=True) if g)
        left = len(w) - lost
        if len(w) < 20 or 100 * len(covered) > 30 * len(w) or (lost and (left < 20 or left < 0.1 * len(w))):
            continue
        out.append((d, "\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g) if lost else t, s))
    return out


def _apart(items, percent=80):
    """Near copies: of each component the least doc_id."""
    sets = []
    for _, t, _ in items:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + minhash.WORDS]) for i in range(max(1, len(w) - minhash.WORDS + 1))} if w else set())
    label = list(range(len(items)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for (d, *_), c in zip(items, label, strict=True):
        least[c] = min(d, least.get(c, d))
    return [x for x, c in zip(items, label, strict=True) if x[0] == least[c]]


def _masked(items):
    out = []
    for (d, t, s), spans in zip(items, _discovered([(d, t or "") for d, t, _ in items]), strict=True):
        found, parts, at = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)), [], 0
        for a, b, k in found:
            if a < at:
                at = max(at, b)
            else:
                parts += [t[at:a], f"<{k}>"]
                at = b
        out.append((d, "".join(parts) + t[at:] if found else t, s))
    return out


def _documents():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(500)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    shared, out = [prose(30), prose(14), "Please accept all cookies before you go on to read the rest of this page"], []
    for i in range(90):
        t = "\n".join(prose(r.randint(6, 40)) for _ in range(r.randint(1, 4)))
        if i % 3 == 0:
            t += "\n" + shared[2].replace(" ", "  " if i % 2 else " ")
        if i % 7 == 0:
            t += "\n" + shared[0].replace(" ", " new ", i % 3)
        if i % 4 == 0:
            t += f"\nplease call me on {'0' if i % 20 == 0 else '+44 20 '}{r.randrange(1000, 9999)} {r.randrange(1000, 9999)} or write to u{i}@mail.example"
        out.append((i, t, f"host{i % 2}"))
    own = [t for i, t, _ in out if i % 3 and i % 4 and i % 7]  # copies with other line ends: not the lines are alike, but the texts
    for i in range(90, 110):
        copy, width = re.split("[ \n]", r.choice(own)), r.randint(4, 5)
        for _ in range(r.choice([0, 1, 3])):
            copy[r.randrange(len(copy))] = "changed"
        out.append((i, "\n".join(" ".join(copy[j : j + width]) for j in range(0, len(copy), width)), f"host{i % 2}"))
    return out + [(200, "", "host0"), (201, None, "host1"), (202, " \n ", None), (203, "too short", "host0"), (204, "again and again " * 40, "host1")]


def test_pipeline_against_loops(spark, tmp_path):
    items = _documents()
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in items], "doc_id long, text string, lang string, source string, n_chars int")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def lines(items):
        gone, _ = _lines_left([(d, t) for d, t, _ in items])
        return [(d, "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i]), s) for i, (d, t, s) in enumerate(items)]

    for i, ((name, stage), plain) in enumerate(zip(corpus_pipeline.STAGES[:-1], (_good, lines, _apart, _masked), strict=True)):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now, before = spark.read.parquet(f"{tmp_path}/{i}"), items
        items = plain(items)
        assert now.columns == df.columns and items != before
        assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in now.collect()) == sorted((d, t, s, len(t)) for d, t, s in items), name
    t, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for d, text, _ in items:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            want[d, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    room = Counter()
    for r in got:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 4096 and len(room) == -(-sum(room.values()) // 4096)


@pytest.mark.parametrize("some", [True, False])
def test_odd_tables(spark, docs, none, tmp_path, some):
    """Nulls, empty and very long texts, repeats and clashing columns; and no rows at all."""
    df = docs if some else none
    df = df.withColumnsRenamed({"key": "__id", "rank": "__mark"})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == some
