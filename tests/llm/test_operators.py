"""Each operator against a brute-force version on small texts, and on odd tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.llm import common, decontamination, embeddings, langid, licenses, packing, quality, simhash, substrings, token_files, tokens, toxicity
from riskmart.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(seed=1, n=60):  # some hold the string of a special token
    rng = random.Random(seed)

    def text(k):
        return "".join(rng.choice(["a", "b", "é", "ccc", "Dog", "don't"]) + rng.choice([" ", "\n", "  ", "\t", ". "]) for _ in range(k))

    shared = text(30)
    rows = [(i, rng.choice([None, "", "  ", text(3), text(80), shared, shared + text(2), text(5) + shared, "a <|endoftext|> b"])) for i in range(n)]
    return rows + [(None, "x y z"), (7, "x y z"), (7, "x y z"), (n, text(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "l", "s", 1, "clash") for i, t in rows_of()], "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def expected_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["", " ", "a\n\nb", "a \nb", "\x00", "a \x00b", "a\x85 b", "<|endoftext|> a", "\n"] + ["".join(rng.choice(" \n\tab.'1\x1c\x00é") for _ in range(rng.randrange(30))) for _ in range(1500)]
    one = Tokenizer.from_file(tokens.default_path())
    plain = [one.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (tokens.REMEMBERED, 10):
        e = tokens.Encoder(tokens.default_path(), remembered)
        for _ in range(2):
            ids, off = e.encode(pa.array(texts, pa.large_string()))
            assert all(np.array_equal(ids[a:b], w) for a, b, w in zip(off[:-1], off[1:], plain, strict=True))
            assert ids[off[7] : off[8]].tolist() == [50256, 257]


def test_another_tokenizer_is_used_whole(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(tokens.default_path(), encoding="utf-8") as f:
        x = json.load(f)
    x["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(x))
    e, one = tokens.Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["two words", "", " a b"]
    ids, off = e.encode(pa.array(texts, pa.large_string()))
    assert not e.fast and tokens.splits_at_spaces(tokens.default_path())
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [one.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, docs, tmp_path, expected_ids):
    path = str(tmp_path / "files")
    token_files.write(docs, path)
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = [(i, expected_ids(t)) for i, t in sorted(rows_of(), key=key)]
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect()), key=lambda r: r[1])
    assert [(r[0], r[2]) for r in got if r[0] != 7] == [(i, len(x)) for i, x in want if i != 7]
    assert sorted((r[0] or -1, r[3]) for r in got) == sorted((i or -1, crc(x)) for i, x in want)
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    back = {r.doc_id: list(r.ids) for r in token_files.read(spark, path).collect() if r.doc_id not in (None, 7)}
    assert back == {i: x for i, x in want if i not in (None, 7)}
    content = next(bytes(r.content) for r in token_files._files(spark, path).collect())
    (row, ids), = token_files.decode_file(content, token_files.dictionary_of(spark, path), {3})
    assert ids.tolist() == dict(want)[3]
    with pytest.raises(ValueError, match="another dictionary"):
        list(token_files.decode_file(content, b"other"))


def test_token_files_of_many_blocks_and_equal_rows(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("BLOCKS", 3), ("PART_BYTES", 4000), ("PARTS_AT_ONCE", 2)):
        monkeypatch.setattr(token_files, name, value)
    rows = [(k, f"some words {k} " * (k % 7)) for k in range(400)] + [(None, "")] * 300 + [(5, "twice")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write(df, str(tmp_path / "f"))
    got = sorted(token_files.digests(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == 900
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    files = [bytes(r.content) for r in token_files._files(spark, str(tmp_path / "f")).collect()]
    assert len(files) > 10 and max(len(list(token_files.blocks(x))) for x in files) == 3
    assert len({int(h["part"]) for x in files for h, _ in token_files.blocks(x)}) > 3


def test_token_files_of_nothing(spark, none, tmp_path):
    token_files.write(none, str(tmp_path / "f"))
    assert token_files.digests(spark, str(tmp_path / "f")).count() == 0


def test_packing(docs, expected_ids, none):
    got = packing.pack_documents(docs, length=32, group_docs=20).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 32
    for i, t in rows_of():
        if i in (None, 7):
            continue
        ids, at = expected_ids(t), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (not k or r.length == 32)
            at += r.length
        assert at == len(ids) and (len(pieces[i]) == 1) == (len(ids) <= 32)
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.1 * total / 32 + 3
    assert packing.pack_documents(none).count() == 0


def test_packing_deals_equal_rows_over_groups(spark):
    df = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'' AS text", "id AS sequence_id")
    got = packing.pack_documents(df, length=16, group_docs=300).collect()
    groups = Counter(r.sequence_id >> 40 for r in got)
    assert len(got) == 3000 and len(groups) == 10 and max(groups.values()) < 500
    assert len({r.sequence_id for r in got}) <= 3000 / 16 + 10


def test_sum_of_squares_takes_the_least_change():
    rng = random.Random(2)
    p, counts = packing.SumOfSquares(20), Counter()
    for _ in range(400):
        size = rng.randrange(1, 21)

        def after(gap):
            c = Counter(counts)
            c[gap] -= gap != 20
            c[gap - size] += gap != size
            return sum(v * v for v in c.values())

        gap = p.gap_for(size)
        choices = [g for g in range(size, 20) if counts[g]] + [20]
        assert size == 20 or after(gap) == min(map(after, choices))
        p.place(size, None)
        counts[gap] -= gap != 20
        counts[gap - size] += gap != size


def brute_fingerprint(text, k):
    from xxhash import xxh64_intdigest

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs, shingle=3).collect()
    rows = rows_of()
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    least = {}
    roots = brute_components(fps)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("pairs", [2, 32])
def test_simhash_links_families_of_any_size(spark, pairs):
    rng, fps = random.Random(1), []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3]))})
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    root = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), pairs)).collect()}
    groups = defaultdict(set)
    for x, r in zip(fps, brute_components(fps), strict=True):
        groups[r].add(root.get(signed(x), signed(x)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_every_pair_in_the_radius_meets_in_some_table():
    tables = [m % 2**64 for m in simhash.masks(2)]
    flips = [1 << a | 1 << b for a in range(64) for b in range(a + 1)]
    assert len(tables) == 7 and all(any(not m & f for m in tables) for f in flips)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


@pytest.mark.parametrize("size", [3, 12])
def test_substrings(docs, size, none):
    rows = rows_of()
    found = [WORD.findall(t or "") for _, t in rows]
    windows = Counter(tuple(w[i : i + size]) for w in found for i in range(len(w) - size + 1))
    want = []
    for (i, _), w in zip(rows, found, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if windows[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), [k for k, g in enumerate(gone) if g]))
    got = substrings.remove_repeats(docs, size, chunk_bytes=900, carry=("lang",)).collect()

    def spread(r):
        return [k for a, b in zip(r.removed[::2], r.removed[1::2], strict=True) for k in range(a, b + 1)]

    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, spread(r)) for r in got), key=str) == sorted(want, key=str)
    assert {r.carry_lang for r in got} == {"l"}
    loose = substrings.remove_repeats(docs, size, one_space=False, stable=False).collect()
    assert Counter((r.doc_id, " ".join(WORD.findall(r.kept))) for r in loose) == Counter((w[0], w[3]) for w in want)
    assert substrings.remove_repeats(none).count() == 0


def thue_morse(n, swap):
    bits = [bin(k).count("1") % 2 ^ swap for k in range(n)]
    return "".join("ab"[b] for b in bits)


def test_substrings_of_words_made_to_collide(spark):
    """Polynomials modulo 2^64 give these words one hash, in whatever base."""
    plain = " ".join(f"w{k}" for k in range(40))
    for n in (1024, 2048):
        rows = [(k, f"{thue_morse(n, k)} {plain}") for k in (0, 1)]
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 41).collect()
        assert {(r.doc_id, r.n_removed, r.kept) for r in got} == {(k, 0, t) for k, t in rows}


def test_run_hashes_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    values = rng.integers(0, substrings.PRIME, 60, np.uint64)
    values[:3] = substrings.PRIME - 1
    for size in (1, 2, 3, 11, 35, 60, 61):
        for base in substrings.BASES:
            want = [sum(int(v) * pow(base, size - 1 - j, substrings.PRIME) for j, v in enumerate(values[k : k + size])) % substrings.PRIME for k in range(max(0, 61 - size))]
            assert substrings.runs(values, size, base).tolist() == want


def test_substrings_of_very_many_equal_rows(spark):
    """A third of the rows is one row: it is dealt over all chunks."""
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", f"if(id % 3 = 0, '{text}', concat('x', id)) AS text")
    got = substrings.remove_repeats(df, chunk_bytes=100_000)
    assert {(r.n_words, r.n_removed, r["count"]) for r in got.groupBy("n_words", "n_removed").count().collect()} == {(50, 50, 10000), (1, 0, 20000)}


def brute_contamination(rows, items):
    """(doc_id, item_id) -> (passage, share, question, answer) by looking at every passage with every item."""
    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    items = [(k, t) for k, t in dict.fromkeys(items) if words(t)]
    bags = [Counter(words(t)) for _, t in items]
    df, mean = Counter(w for b in bags for w in b), sum(map(Counter.total, bags)) / len(bags)
    found = {}
    for (k, item), bag in zip(items, bags, strict=True):
        weight = {w: np.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for w, f in bag.items()}
        cut = [m.end() for m in re.finditer(r"[.!?](?=[\x20\x09-\x0D])", item) if words(item[m.end() :])]
        w = words(item)
        parts = (words(item[: cut[-1]]), words(item[cut[-1] :])) if cut else (w[: len(w) - len(w) // 4], w[len(w) - len(w) // 4 :])
        stride = 64
        while stride < len(w):
            stride *= 2
        for n, (i, t) in enumerate(rows):
            text = words(t)
            for p in range(max(1, -(-len(text) // stride) - 1)):
                own = text[p * stride : (p + 2) * stride]
                share = sum(v for y, v in weight.items() if y in set(own)) / sum(weight.values())
                if share >= 0.6 - 1e-9:
                    overlap = []
                    for part in parts:
                        size = min(3, len(part))
                        mine = {tuple(part[a : a + size]) for a in range(len(part) - size + 1)}
                        theirs = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)}
                        overlap.append(len(mine & theirs) / len(mine) if size else 1.0)
                    if min(overlap) >= 0.5 and (n, k) not in found or min(overlap) >= 0.5 and found[n, k][1] < share - 1e-12:
                        found[n, k] = (p, share, *overlap)
    return Counter((rows[n][0], k, p, *(round(x, 9) for x in v)) for (n, k), (p, *v) in found.items())


def test_decontamination(spark, none):
    rng = random.Random(4)
    vocabulary = ["w" + "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{text(12)}. {text(6)}.") for k in range(40)] + [(40 + k, f"{text(8 + k)}? {text(k % 4 + 1)}.") for k in range(8)] + [(60 + n, text(n)) for n in range(1, 14)]
    items += [(80, f"{text(150)}. {text(9)}."), (81, f"{text(700)}. {text(9)}."), (90, None), (91, ""), (3, items[3][1]), (82, items[3][1])]
    rows = [(k, text(rng.randrange(5, 300))) for k in range(60)] + [(None, items[3][1]), (200, None), (201, "")]
    for k, (i, t) in enumerate(items[:63]):
        rows.append((100 + k, f"{text(100)} {t.upper() if k % 2 else t} {text(70)}"))
        rows.append((300 + k, f"{text(rng.randrange(900))} {' '.join(x if rng.random() < 0.85 else 'zz' for x in t.split())} {text(70)}"))
    rows += rows[60:64]
    docs, bench = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    assert sum((100 + k, i) in {x[:2] for x in want} for k, (i, _) in enumerate(items[:63])) == 63
    for shard in (decontamination.SHARD_BYTES, 3000):
        got = Counter((r.doc_id, r.item_id, r.passage, round(r.share, 9), round(r.question, 9), round(r.answer, 9)) for r in decontamination.contaminated(docs, bench, shard_bytes=shard).collect())
        assert got == want
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("item_id in (90, 91)")).count() == 0


def test_a_long_benchmark_item_changes_nothing_for_the_others(spark):
    rng = random.Random(14)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(k, f"{text(12)}. {text(6)}.") for k in range(30)]
    docs = spark.createDataFrame([(k, f"{text(2000)} {items[k % 30][1]} {text(2000)}") for k in range(12)], "doc_id long, text string")
    for more in ([], [(99, text(9000))]):
        bench = spark.createDataFrame([*items, *more], "item_id long, text string")
        assert {(r.doc_id, r.item_id, r.passage) for r in decontamination.contaminated(docs, bench).collect() if r.item_id < 99} == {(k, k, 2000 // 64 - 1) for k in range(12)}


def test_language(spark, none):
    rng = random.Random(3)
    words = {"xx": ["thing", "other", "where", "wash"], "yy": ["été", "leçon", "oiseau", "quai"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(["xx", "yy"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "12 !", "xx"), (902, text("yy", 5), None), (None, text("xx", 40000), "xx")], "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~common.held_out()))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs, model).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "yy" and got[None][0] == "xx"
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def brute_language(model_rows, text, sample=3000):
    """Log probabilities by hand, n-gram by n-gram; hashes are the operator's."""
    import pyarrow as pa

    def buckets(t):
        codes, owner, _ = langid.characters(pa.array([t], pa.large_string()))
        return Counter(int(b) for part, _ in langid.grams(codes, owner) for b in part)

    out = {}
    for lang in {x for _, x in model_rows}:
        own = [t for t, x in model_rows if x == lang]
        seen = sum((buckets(t) for t in own), Counter())
        total = seen.total() + 0.5 * langid.BUCKETS
        out[lang] = np.log(len(own) / len(model_rows)) + sum(n * np.log((seen[b] + 0.5) / total) for b, n in buckets(text).items()) / 3
    return out


@pytest.mark.parametrize("block", [2, 128])
def test_language_equals_brute_force_for_any_number_of_languages(spark, none, block):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x61, 0x61 + 26)] + [chr(c) for c in range(0x430, 0x450)]
    n = 80 if block > 2 else 5
    alphabets = {f"l{k}": rng.sample(letters, 6) for k in range(n)}
    text = lambda lang: " ".join("".join(rng.choices(alphabets[lang], k=4)) for _ in range(12))
    rows = [(7 if k < 2 * n else k, text(f"l{k % n}"), f"l{k % n}", "x") for k in range(4 * n)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, best string")
    model = langid.fit(docs, block=block)
    assert len(model.languages) == n and len(model.blocks) == -(-n // block)
    got = langid.predict(docs, model).collect()
    pairs = [(t, x) for _, t, x, _ in rows]
    for r in got[:: 1 if n < 9 else 40]:
        want = brute_language(pairs, r.text)
        best = max(want, key=want.get)
        assert r.lang_pred == best and r.best == "x"
        assert abs(r.lang_score - 1 / sum(np.exp(v - want[best]) for v in want.values())) < 1e-4
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert langid.predict(none, model).columns == [*none.columns, "lang_pred", "lang_score"] and langid.predict(none, model).count() == 0


def test_quality(spark, none):
    rng = random.Random(6)
    good = lambda: ". ".join(" ".join(rng.choice(["some", "plain", "words", "of", "text", "here", "there"]) + rng.choice(["", "", "s"]) for _ in range(9)).capitalize() for _ in range(5))
    bad = lambda: " ".join([rng.choice(["BUY", "NOW!!", "$$$", "W1N"])] * rng.randrange(3, 40))
    rows = [(k, good() if k % 3 else bad()) for k in range(150)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(100)] + [(101, None), (None, 1)], "doc_id long, quality int")
    x = quality.features(docs)
    got = {r.doc_id: r.score for r in quality.score(x, quality.fit(x, labels)).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in range(100, 150)]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert {r.score for r in quality.score(x, quality.fit(x, labels.where("false"))).collect()} == {0.5}
    assert quality.features(none).count() == 0


def brute_statistics(text):
    """The seventeen numbers of a text, from their definitions."""
    b = (text or "").encode()
    w, lines = re.findall(rb"[^\x20\x09-\x0D]+", b), re.findall(rb"[^\n\x0b\x0c\r]+", b)
    logit = lambda k, n, usual, weight: np.log((k + usual * weight) / (n - k + (1 - usual) * weight))
    n, m, k = len(b), len(w), len(lines)
    upper, high = sum(65 <= c <= 90 for c in b), sum(c >= 128 for c in b)
    letters = upper + high + sum(97 <= c <= 122 for c in b)
    marks = sum(c in b".,;:!?'\"()-" for c in b)
    symbol = lambda c: chr(c) in "#$%&*+/<=>@[\\]^_`{|}~"
    capitals = [sum(65 <= c <= 90 for c in x) for x in w]
    return [
        np.log1p(n), np.log1p(m), np.log1p(k), np.log((sum(map(len, w)) + 180) / (m + 30)), np.log((m + 150) / (k + 5)),
        logit(upper, letters, 0.03, 200), logit(letters, n, 0.82, 200), logit(sum(48 <= c <= 57 for c in b), n, 0.002, 200), logit(marks, n, 0.03, 200), logit(sum(map(symbol, b)), n, 0.001, 200),
        logit(len(set(w)), m, 0.8, 30), logit(max(Counter(w).values(), default=0), m, 0.05, 30), logit(sum(x == y for x, y in zip(w, w[1:], strict=False)), m, 0.01, 30), logit(len(set(lines)), k, 0.98, 5),
        logit(sum(len(x) <= 2 for x in w), m, 0.2, 30), logit(sum(u >= 2 and 2 * u >= len(x) for u, x in zip(capitals, w, strict=True)), m, 0.005, 30), logit(sum(33 in x or any(map(symbol, x)) for x in w), m, 0.005, 30),
    ]


def test_quality_equals_brute_force(spark):
    rng = random.Random(16)
    word = lambda: rng.choice(["some", "a", "of", "BUY", "W1N!", "$$", "été", "don't", "x_y", "Here", "is"])
    texts = [" ".join(word() + rng.choice(["", "", ".", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(120)] + [None, "", " \n", "one", "word " * 30000]
    rows = [(k % 110, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    marks = [(k, rng.randrange(2)) for k in range(80)] + [(3, 1), (3, 0), (5, None), (6, 7), (None, 1), (999, 1)]
    got = quality.features(docs).collect()
    want = [(k, brute_statistics(t)) for k, t, _ in rows]
    for r, (k, x) in zip(sorted(got, key=lambda r: (r.doc_id, r.x)), sorted(want, key=lambda r: (r[0], list(r[1]))), strict=True):
        assert r.doc_id == k and np.allclose(r.x, x, atol=1e-9)
    x = [[np.array(v) for k, v in want for i, y in marks if i == k and y == label] for label in (0, 1)]
    n, cov = [len(v) for v in x], [np.cov(np.array(v).T, bias=True) for v in x]
    pooled = np.maximum(np.diag(n[0] * cov[0] + n[1] * cov[1]) / sum(n), 1e-3)
    cov = [0.9 * c + 0.1 * np.diag(pooled) for c in cov]
    score = {}
    for k, v in want:
        d = [-0.5 * ((v - np.mean(m, 0)) @ np.linalg.inv(c) @ (v - np.mean(m, 0)) + np.linalg.slogdet(c)[1]) + np.log(len(m)) for m, c in zip(x, cov, strict=True)]
        score.setdefault(k, []).append(1 / (1 + np.exp(np.clip(d[0] - d[1], -500, 500))))
    frame = common.materialise(quality.features(docs), "test")
    found = defaultdict(list)
    for r in quality.score(frame, quality.fit(frame, spark.createDataFrame(marks, "doc_id long, quality int"))).collect():
        found[r.doc_id].append(r.score)
    assert all(np.allclose(sorted(found[k]), sorted(v), atol=1e-6) for k, v in score.items())


def brute_chain(chain, text):
    from riskmart.llm import words

    def bucket(piece, k):
        data = np.frombuffer(piece, np.uint8)
        h = words.hashes(data, np.array([0]), np.array([len(piece)]))[0] * np.uint64(2 * k + 1 if k else 1)
        return int(h >> np.uint64(46))

    have = set()
    for w in re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", (text or "").encode().lower()):
        have |= {bucket(w, 0)} | {bucket(w[:k], k) for k in toxicity.PREFIXES if len(w) > k}
    columns, p = {int(chain.column[b]) for b in have} - {-1}, []
    for m in chain.models:
        if m.constant is not None:
            p.append(m.constant)
            continue
        n = len(m.weight) - 1 - len(p)
        z = sum(m.weight[c] for c in columns) + sum(w * x for w, x in zip(m.weight[n:-1], p, strict=True)) + m.weight[-1]
        p.append(1 / (1 + np.exp(-z)))
    return p


def test_toxicity(spark, none):
    rng = random.Random(8)
    plain = ["river", "stone", "lamp", "green", "walk", "seven", "paper", "cloud"]
    text = lambda *more: " ".join([*rng.choices(plain, k=30), *more])
    bad = [["grobb", "frimp", "zott"], ["vequista", "moltra", "hunfel"]]
    rows = [(k, text(*(rng.sample(bad[k // 4 % 2], 2) if k % 4 == 0 else []))) for k in range(400)]
    rows += [rows[0], (1000, text(*bad[0]) * 800)]
    docs = spark.createDataFrame([(*r, "x") for r in [*rows, (900, None), (901, ""), (None, "grobb")]], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(300)] + [(0, 1, "y"), (301, None, "z")], "doc_id long, toxic int, text string")
    chain = toxicity.fit(toxicity.with_labels(docs, toxicity.sample_labels(labels)))
    assert chain.categories == ["toxic_kind_1", "toxic_kind_2", "toxic"]
    found = toxicity.predict(docs, chain).collect()
    got = {r.doc_id: r for r in found}
    assert np.mean([got[k].is_toxic == (k % 4 == 0) for k in range(300, 400)]) >= 0.97 and got[1000].is_toxic
    kinds = [(got[k].p_toxic_kind_1 > got[k].p_toxic_kind_2) == (k // 4 % 2 == 0) for k in range(300, 400, 4)]
    assert np.mean(kinds) >= 0.95 or np.mean(kinds) <= 0.05  # the clusters are the two vocabularies
    assert not got[900].is_toxic and got[900].p_toxic == got[901].p_toxic and len(found) == 405
    texts = dict(rows)
    for k in (0, 1, 4, 301, 304, 1000):
        assert np.allclose([got[k].p_toxic_kind_1, got[k].p_toxic_kind_2, got[k].p_toxic], brute_chain(chain, texts[k]), atol=1e-9)
    assert {r.p_toxic for r in toxicity.predict(docs, toxicity.fit(toxicity.with_labels(docs, labels.where("false")))).collect()} == {0.0}
    assert toxicity.predict(none, chain).count() == 0
    two = spark.createDataFrame([(k, t, k % 2, k % 4 // 2) for k, t in rows[:100]], "doc_id long, text string, odd int, high int")
    assert toxicity.fit(two, ("odd", "high")).categories == ["odd", "high"]


def test_logistic_regression_equals_newton():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 6)) < 0.3).astype(float)
    p = rng.random((200, 1))
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [1, -1, 2, 0, 0, 0.5] + p[:, 0] - 1)))).astype(float)
    row, column = np.nonzero(x)
    w = toxicity.train(row, column, p, y, 6).weight
    full, v = np.column_stack([x, p, np.ones(200)]), np.zeros(8)
    penalty = np.diag([1.0] * 7 + [0.0]) * toxicity.PENALTY
    for _ in range(50):
        q = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve((full * (q * (1 - q))[:, None]).T @ full + penalty, full.T @ (q - y) + penalty @ v)
    assert np.abs(w - v).max() < 0.01


def test_licenses(spark, none):
    s = licenses.SENTENCES
    rows = [(1, "\n".join(s["mit-grant"] + ["other words."] + s["mit-condition"] + s["as-is-mit"])), (2, "x. Released under the MIT License. y\nRELEASED  under the mit license"), (3, None), (4, ""), (5, s["bsd-allowed"][0] + ":\n" + "; ".join(s["bsd-source"] + s["bsd-binary"])), (6, s["gpl3-grant"][0]), (None, "MIT License")]
    docs = spark.createDataFrame(rows + rows[1:2], "doc_id long, text string")
    got = Counter((r.doc_id, r.rule, r.n_matches) for r in licenses.scan(docs).collect())
    assert got == {(1, "mit-text", 1): 1, (2, "mit-notice", 2): 2, (5, "bsd-2-text", 1): 1, (None, "mit-notice", 1): 1}
    assert licenses.scan(none).count() == 0


def test_embeddings_find_all_links(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(500):
        e = rng.standard_normal(32)
        if i % 3 and rows:
            e = np.array(rows[rng.integers(0, len(rows))][2])
            e = e / np.linalg.norm(e)
            if i % 3 == 1:
                t = rng.standard_normal(32)
                t -= t @ e * e
                c = rng.uniform(0.925, 0.945)
                e = c * e + np.sqrt(1 - c * c) * t / np.linalg.norm(t)
        rows.append((i, i % 2, [float(x) for x in np.float32(e)]))
    odd = [(900, None, [1.0] * 32), (901, 1, None), (902, 1, [0.0] * 32), (903, 1, [float("nan")] * 32), (904, 1, []), (905, 1, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>")
    parent = {i: i for i, *_ in rows + odd}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for label in (0, 1):
        own = [(i, np.array(e) / np.linalg.norm(e)) for i, k, e in rows if k == label]
        x = np.array([e for _, e in own])
        for a, b in np.argwhere(np.triu(x @ x.T >= 0.93, 1)):
            i, j = own[a][0], own[b][0]
            n[i] += 1
            n[j] += 1
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    for tile in (60, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (n[i], find(i), find(i) == i) for i in parent}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_of_text_labels_repeated_ids_and_copies_to_scale(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 16))
    rows = [(k, "ab"[k % 2], [float(v) for v in x[k]], "c") for k in range(6)]
    rows += [(20 + k, "a", [float(v * (k + 2)) for v in x[0]], "c") for k in range(5)] + [(20, "b", [float(v) for v in x[0]], "c"), (30, None, rows[0][2], "c")]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>, tile string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    want = [(0, 5, 0, True), *[(k, 0, k, True) for k in range(1, 6)], (20, 5, 0, False), *[(20 + k, 5, 0, False) for k in range(1, 5)], (20, 0, 0, False), (30, 0, 30, True)]
    assert got == Counter(want)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage, item, base = text(60), f"{text(12)}. {text(6)}.", text(120)
    rows = [(k, text(90)) for k in range(20)] + [(50, base), (51, base), (60, f"{text(40)} {passage} {text(40)}"), (61, f"{text(40)} {passage}"), (70, f"{text(60)} {item}"), (80, "12 34"), (None, text(50)), (82, None)]
    spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = common.table(spark, str(tmp_path), "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert ids["language"] == {i for i, _ in rows} - {80, 82}
    assert ids["near_duplicates"] == ids["language"] - {51} == ids["substring_dedup"]
    assert all(passage not in r.text for r in seen["substring_dedup"])
    assert {r.doc_id: r.text for r in seen["substring_dedup"] if r.doc_id in range(20)} == dict(rows[:20])
    assert ids["decontamination"] == ids["substring_dedup"] - {70} == ids["packing"]
    assert len({hashlib.md5(str(r).encode()).hexdigest() for r in seen["packing"]}) == len(seen["packing"])


def test_toxicity_sample_is_bounded_whatever_the_ids(spark):
    for i in (42, 7, None):  # one id has all labelled rows
        one = spark.range(0, 20_000, 1, 4).select(F.lit(i).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
        assert toxicity.sample_labels(one, 1000).count() == 1000
    some = spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert toxicity.sample_labels(some, 500).count() == 500
    docs = spark.range(0, 3000, 1, 4).select(F.lit(42).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 5).alias("text"))
    joined = toxicity.with_labels(docs, toxicity.sample_labels(one.withColumn("doc_id", F.lit(42)), 1000))
    assert joined.count() == 2 * 3000  # each of the two labels
    chain = toxicity.fit(joined, sample=200)
    assert {round(r.p_toxic, 1) for r in toxicity.predict(docs.limit(5), chain).collect()} == {0.5}


def test_encoder_keeps_to_the_words_it_may_remember():
    assert tokens.encoder(remembered=1000).remembered == 1000
    assert tokens.encoder(remembered=5).remembered == 5 and tokens.encoder(remembered=5) is tokens.encoder(remembered=5)
    assert list(tokens._encoders) == [tokens.default_path()]


def test_dictionary_of_very_long_texts_is_bounded(spark):
    long = spark.range(0, 12, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" seven little words of a long text."), 60_000)).alias("text"))
    assert 0 < len(token_files.train_dictionary(long, sample=12)) <= token_files.DICTIONARY_BYTES


def test_embeddings_scaled_copies_and_one_very_common_vector(spark):
    """900 multiples of one vector share label and projection, and are cut into tiles all the same; 2,000 rows have one vector, with adaptive execution off."""
    rng = np.random.default_rng(6)
    base, common_one = rng.normal(size=8), rng.normal(size=8)
    rows = [(i, (base * (1 + i / 7)).tolist(), 1) for i in range(900)] + [(1000 + i, common_one.tolist(), 2) for i in range(2000)] + [(5000 + i, rng.normal(size=8).tolist(), 2) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, weight int").repartition(4)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, tile=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert len(got) == len(rows) and all(got[i] == (899, 0) for i in range(900))
    x = np.array([r[1] for r in rows[900:]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= embeddings.THRESHOLD).sum(1) - 1
    assert [got[r[0]][0] for r in rows[900:]] == links.tolist() and got[1999][1] == 1000
    assert embeddings.near_duplicates(df.where("false")).count() == 0
