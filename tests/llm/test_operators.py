"""The training-data operators against brute force, on small and awkward tables."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import packing, pii, simhash, substrings, tokens
from newsloom.llm.queries import tokenizer

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
TEXTS = [None, "", " \n\t ", "one", "a b", "é日 😀 x", "same text here " * 30, "same text here " * 30, LONG, "Call +1 (415) 555-0100 or mail a.b@c.example.org now", "4111 1111 1111 1111 and 10.0.0.256 and 10.0.0.1"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = " ".join(rnd.choices(vocabulary, k=60))
    texts = list(TEXTS)
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 200))
        if i % 3 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = shared.split()[rnd.randint(0, 20) : rnd.randint(40, 60)]
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
    texts += texts[20:24]
    rows = [(i if i % 17 else None, t, f"clash{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, copies int").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return SPACES.findall(text or "")


def test_substrings(docs):
    texts = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    want = []
    for doc_id, w in texts:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows(substrings.remove_repeats(docs)) == sorted(want, key=repr)


def test_substrings_of_an_empty_table(docs):
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_simhash(docs):
    import xxhash

    def mark(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words(w)
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.simhash_components(docs).collect()
    texts = [(r.doc_id, mark(r.text)) for r in docs.collect()]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i][1] ^ texts[j][1]).bit_count() <= 3:
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(texts):
        least[find(i)].append(doc_id)
    want = [(d, f"{m:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, m) in enumerate(texts)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_simhash_plan_misses_no_pair(spark, radius):
    rnd = random.Random(radius)
    marks = {rnd.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        for _ in range(6):
            marks.add(m ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, radius + 1))))
    nodes = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long")
    groups = {r.fp: r.root for r in simhash.linked_groups(nodes, {"fp": radius}).collect()}
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a, b in itertools.combinations(marks, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    of = defaultdict(set)
    for m in marks:
        of[find(m)].add(groups[simhash.signed(m)])
    assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)


def test_tokens_of_white_space_and_words_remembered():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "\u2003", "\u3000", "'s", "'", "a", "B", "1", "\u00e9", "<|endoftext|>", ".", "\U0001f600", "word", "\x00"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(3000)] + [None, "q" * 50000]
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    whole, ranks = tokens.whole_tokens(path), tokens.merge_ranks(path)
    assert ranks is not None
    for given in (ranks, None):
        counting = tokens.Counting(path, whole, given)
        assert [n for i in range(0, len(texts), 64) for n in counting.counts(texts[i : i + 64])] == want


def test_tokens(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    more = ["a<|endoftext|>  b", "\u001c x  y", "don't  \n\n  stop"]
    texts = docs.union(docs.sparkSession.createDataFrame([(100 + i, t, "", 0) for i, t in enumerate(more)], docs.schema))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 1024) for r in texts.collect()]
    assert rows(tokens.token_counts(texts, tokenizer("byte_bpe_50k.json"))) == sorted(want, key=repr)


def test_pii_base_patterns_are_the_plain_ones():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(2)
    for _ in range(20_000):
        text = "".join(rnd.choices(rnd.choice(["ab@.-_+ 1", "0123 -.+()@", "12.", "4 -1+", "@a.", "é@a.b1+ (5)"]), k=rnd.randint(0, 50)))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".") if x.isdigit()), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
                want += [(m.start(), m.end(), kind)] if good else []
        assert pii.spans_of(text, 2)[0] == sorted(want, key=lambda x: (x[0], pii.BASE_KINDS.index(x[2])))


def test_pii_table(docs):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).where("doc_id in (9, 10)").collect()}
    assert got[9].spans == "phone:5:22,email:31:48" and got[10].spans == "card:0:19,ip:39:47"
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.redacted("x a@b.co y", pii.spans_of("x a@b.co y", 0.7)[1]) == "x <email> y"


def test_quality(docs):
    from newsloom.llm.quality import quality

    told = quality(docs).select("row.doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for r in told:
        w = words(r.text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert len(told) == docs.count()


def test_packing(docs):
    got = packing.pack(docs, budget=300, buckets=4).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(words(r.text)) for r in docs.collect())
    assert len({(r.bucket_len, r.batch, r.slot) for r in got}) == len(got)
    for (size, _), n in Counter((r.bucket_len, r.batch) for r in got).items():
        assert n <= max(1, 300 // max(size, 1))
    assert packing.pack(docs.limit(0)).count() == 0


def test_bucket_bounds_are_optimal():
    rnd = random.Random(3)
    for _ in range(100):
        lengths, most = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 10))], rnd.randint(1, 4)
        tops = sorted(set(lengths))
        cost = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths)  # noqa: B023, E731
        best = min(cost((*c, tops[-1])) for k in range(most) for c in itertools.combinations(tops[:-1], min(k, len(tops) - 1)))
        found = packing.boundaries([(t, lengths.count(t)) for t in tops], most)
        assert cost(found) == best and len(found) <= most


def test_bucket_bounds_of_many_lengths_are_optimal():
    """Against the plain programme over every pair of bounds, on the lengths of real texts."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    seen = sorted(Counter(len(words(t)) for t in texts).items())
    tops, c, s = [t for t, _ in seen], np.cumsum([0, *(n for _, n in seen)]), np.cumsum([0, *(t * n for t, n in seen)])
    best = [tops[j] * c[j + 1] - s[j + 1] for j in range(len(seen))]
    for _ in range(5):
        best = [min(best[j], *((best[i - 1] if i else 0) + tops[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i]) for i in range(j + 1))) for j in range(len(seen))]
    bounds = packing.boundaries(seen, 6)
    assert sum(n * (min(b for b in bounds if b >= t) - t) for t, n in seen) == best[-1] and len(bounds) <= 6


def test_warc(spark):
    from newsloom.llm.warc import round_trip

    false = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    pages = [(1, "u", None), (2, "u", ""), (3, "a\r\nb", f"x{false}y{false}"), (4, "u", false), (5, None, false), (6, "u", "\r\n\r\n"), (7, "u", "WARC/1.1\r\n" * 50), (None, "u", "é")]
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        data, top = (h or "").encode(), last[h or ""]
        again = top >= 0 and top != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert rows(round_trip(table)) == sorted(want, key=repr)
    assert round_trip(table.limit(0)).count() == 0


def test_nearest(spark):
    from newsloom.llm.ann import nearest

    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[40]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(None, [1.0] * 16, 0), (9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None, *[1.0] * 15], 0), (9020, [2.0, 1.0], 0), (9040, [1.0, 1.0], 0)]
    got = nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), shard_rows=400).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        s = (y * y[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hits += len({i for i, _ in by[q]} & set(best))
        assert np.allclose([v for _, v in by[q]], s[[i for i, _ in by[q]]], rtol=1e-12)
    assert hits / (75 * 20) >= 0.9
    assert by[9020] == [(9040, 3.0)] and by[9040] == [(9020, 3.0)] and 9002 not in by


def test_lm_score(spark, docs):
    from newsloom.llm.lm import score

    texts = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(None, 1)], "doc_id long, quality int")
    got = score(texts, labels)
    told = {r.doc_id: r for r in got.collect()}
    assert all((r.score is None) == (r.n_words == 0) for r in told.values())
    mean = lambda odd: np.mean([r.score for i, r in told.items() if r.score is not None and i < 40 and i % 2 == odd])
    assert mean(1) < mean(0)
    assert sum(r.n_words for r in told.values()) == sum(len(words(r.text)) for r in texts.collect())


def test_pieces(docs):
    import sentencepiece

    from newsloom.llm.pieces import decode, encode, round_trip

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["  a b\n\tc ｆ é日 \u0001", "a" * 300, "ab" * 700 + "日" * 200, "x\r\n" + " " * 37 + "y", " " * 50, "naïve 😀", "\u2581 mark"]
    texts = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for hot in (50, 0):
        got = decode(encode(texts, path, ("doc_id", "text"), hot=hot), path).collect()
        assert len(got) == texts.count()
        for r in got:
            assert r.ids == model.encode(r.text or "") and (r.decoded == (r.text or "") or "\u2581" in r.text)
    told = {r.doc_id: r for r in round_trip(texts, path).where("doc_id >= 100").collect()}
    for i, t in enumerate(more):
        ids = model.encode(t)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (told[100 + i].n_pieces, told[100 + i].n_byte_pieces, told[100 + i].ids_sha256) == (len(ids), sum(model.is_byte(x) for x in ids), sha)
    assert round_trip(texts.limit(0), path).count() == 0


def test_viterbi_takes_the_best_path_of_the_lattice(spark):
    from newsloom.llm.pieces import viterbi

    rnd = random.Random(12)
    scores = {}
    while len(scores) < 60:
        scores["".join(rnd.choices("abc", k=rnd.choice((1, 1, 2, 2, 3, 4, 5))))] = -rnd.random() * 9
    scores.pop("c", None)  # a character in no piece
    units = sorted({"".join(rnd.choices("abcd", k=rnd.randint(1, 12))) for _ in range(150)})
    table = spark.createDataFrame(list(scores.items()), "piece string, score double")
    got = {r.unit: [ord(c) for c in r.lengths] for r in viterbi(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()}
    unknown = min(scores.values()) - 10

    def value(u, lengths):
        at, total = 0, 0.0
        for n in lengths:
            piece = u[at : at + n]
            total += scores[piece] if piece in scores else unknown if n == 1 else float("-inf")
            at += n
        return total if at == len(u) else float("-inf")

    for u in units:
        best = max(value(u, [j - i for i, j in itertools.pairwise((0, *c, len(u)))]) for k in range(len(u)) for c in itertools.combinations(range(1, len(u)), k))
        assert value(u, got[u]) == pytest.approx(best, rel=1e-12)


def test_near_copies_leave_one(spark):
    rnd = random.Random(9)
    vocabulary = [f"{rnd.choice('abcdefgh')}{i}xy" for i in range(3000)]
    base = [rnd.choices(vocabulary, k=300) for _ in range(12)]
    data = []
    for w in base:
        for c in range(4):
            copy = list(w)
            for at in rnd.sample(range(300), c):
                copy[at] = rnd.choice(vocabulary)
            data.append((len(data), " ".join(copy), "en", "s", 0))
    data.append((len(data), None, "en", "s", 0))
    kept = simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 48, 4), 48]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(r.doc_id for r in at.collect())
    assert at.where(F.col("text").rlike(r"@mail\d")).count() == 0
