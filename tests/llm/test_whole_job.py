"""Losses that a review found: whole rows against plain Python on small tables."""

import math
import random
from collections import Counter

import pytest

from newsloom.llm import lm, packing, pii, simhash, substrings
from newsloom.llm.queries import tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rnd, n):
    return " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}xy" for _ in range(n))


def test_a_repeated_row_keeps_its_text_through_both_dedups(spark):
    rnd = random.Random(4)
    rows = [(i, text_of(rnd, 80), "en", "s", 0) for i in range(5)]
    docs = spark.createDataFrame([*rows, rows[2], rows[2], (None, rows[3][1], "en", "s", 0)], COLUMNS)
    kept = simhash.drop_near_copies(docs)
    assert sorted(tuple(r) for r in kept.collect()) == rows
    assert sorted((r.doc_id, r.text) for r in substrings.without_repeats(kept).collect()) == [r[:2] for r in rows]


def cosine(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / max(1, len(sets[0]) * len(sets[1])) ** 0.5


def test_near_copies_by_appending_cutting_and_substituting(spark):
    rnd = random.Random(6)
    texts = []
    for i in range(40):
        base = text_of(rnd, 120)
        w = base.split()
        texts.append(base)
        texts.append(f"{base} {text_of(rnd, 45 + i % 30)}")  # cosine 0.78 to 0.85
        texts.append(" ".join(w[: 70 + i % 20]))  # 0.75 to 0.86
        changed = list(w)
        for at in rnd.sample(range(0, 120, 8), 3 + i % 3):  # 0.8 and above, or just below
            changed[at] = "changed"
        texts.append(" ".join(changed))
    rnd.shuffle(texts)
    texts += [None, "", " \n", "a b", "A b", texts[0].upper()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            blank = not (texts[i] or "").split() and not (texts[j] or "").split()
            if blank or cosine(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = simhash.drop_near_copies(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == [rows[i] for i in range(len(rows)) if find(i) == i]


def test_lm_score_counts_every_word_and_pair(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 20)  # several buckets
    rnd = random.Random(8)
    # more distinct words than 2 ^ 18
    texts = [" ".join(f"w{rnd.randrange(1 << 30)}" if rnd.random() < 0.5 else f"c{rnd.randrange(50)}" for _ in range(1500)) for _ in range(400)]
    texts += [None, " \n", "one", texts[0]]
    ids = [i if i != 7 else None for i in range(len(texts))]
    labels = [(i, i % 2) for i in range(0, 300)] + [(2, 1), (None, 1)]
    good = {i for i, q in labels if q == 1 and i is not None}
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in zip(ids, texts):
        w = (t or "").split()
        one[i not in good].update(w)
        two[i not in good].update(zip(w, w[1:]))
    vocabulary = len(set(one[0]) | set(one[1]))
    assert vocabulary > 1 << 18
    total = [sum(x.values()) for x in one]

    def loss(w, m):
        out = 0.0
        for i, x in enumerate(w):
            p = (one[m][x] + 1) / (total[m] + vocabulary)
            if i and one[m][w[i - 1]]:
                p = 0.6 * two[m][w[i - 1], x] / one[m][w[i - 1]] + 0.4 * p
            out -= math.log(p)
        return out / len(w)

    got = lm.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(texts)
    found = {r.doc_id: r for r in got}
    for i, t in zip(ids, texts):
        w, r = (t or "").split(), found[i]
        assert r.n_words == len(w)
        if w:
            a, b = loss(w, 0), loss(w, 1)
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((a, b, a - b), rel=1e-9)
        else:
            assert r.target_loss is None and r.score is None
    none = lm.score(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert none.count() == 0


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("my social security number 123-45-6789 is", "ssn", "123-45-6789"),
        ("order 123-45-6789 is", "ssn", None),
        ("to DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB82 WEST 1234 5698 7654 32 EUR 500", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("(GB82WEST12345698765432)", "iban", "GB82WEST12345698765432"),
        ("NO93 8601 1117 947 THE", "iban", "NO93 8601 1117 947"),
        ("XX12 ABCD GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("GB82 WEST 1234 5698 7654 33 EUR 500", "iban", None),
        ("GB82WEST12345698765432x", "iban", None),
    ],
)
def test_pii_in_running_text(text, kind, found):
    told = pii.spans_of(text, 0.7)[1]
    assert [text[a:b] for a, b, k in told if k == kind] == ([found] if found else [])
    assert found is None or f"<{kind}>" in pii.redacted(text, told)


def test_packing_by_tokens(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    texts = [None, "", "q7" * 900, *[text_of(rnd, 1 + i % 60) for i in range(80)]]
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), budget=900, buckets=4, path=path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    for size, n in Counter((r.bucket_len, r.batch) for r in got).items():
        assert n == 1 or n * size[0] <= 900
    assert all(r.n_padding == r.bucket_len - r.n_tokens >= 0 for r in got)


def test_op10_counts_tokens(spark):
    from newsloom.llm.queries import op3_token_counts, op10_packing

    sf = "/root/testdata/sf0.001"
    count = lambda q: sorted((r.doc_id, r.n_tokens) for r in q(spark, sf).collect())
    assert count(op10_packing) == count(op3_token_counts)


GROWTH = """
from newsloom.llm import tokens
def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20
sizes = []
for _ in range(5):
    proved = tokens.whole_tokens({path!r}), tokens.merge_ranks({path!r})
    del proved
    sizes.append(held())
print(sizes[-1] - sizes[0])
"""


def test_proofs_of_a_tokenizer_leave_the_driver_no_larger():
    import subprocess
    import sys
    from pathlib import Path

    told = subprocess.run([sys.executable, "-c", GROWTH.format(path=tokenizer("byte_bpe_50k.json"))], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(told.stdout) < 30  # MB; 80 and more when each call proves anew


def test_a_changed_tokenizer_is_proved_anew(tmp_path):
    import json

    from newsloom.llm import tokens

    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = json.load(f)
    path, ranks = tmp_path / "own.json", []
    for n in (50, 40):
        model = made["model"]
        alone = [x for x in model["vocab"] if len(x) == 1]
        merges = [m for m in model["merges"] if len("".join(m.split(" ") if isinstance(m, str) else m)) == 2][:n]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        vocab = {x: i for i, x in enumerate([*alone, *joined])}
        path.write_text(json.dumps({**made, "added_tokens": [], "model": {**model, "vocab": vocab, "merges": merges}}), encoding="utf-8")
        ranks.append((len(tokens.merge_ranks(str(path))), len(tokens.merge_ranks(str(path)))))
    assert ranks == [(306, 306), (296, 296)]
