import random
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import sentence_spans as S

MASK = (1 << 64) - 1


def split(text):
    """An independent splitter: the sentences as lists of words, word by word, and whether they end with a stop or a line."""

    def mixed(z):
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    out, stops, now, last = [], [], [], None
    found = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", text))
    for k, m in enumerate(found):
        now.append(m.group())
        gap = text[m.end() : found[k + 1].start()] if k + 1 < len(found) else "\n"
        h = xxhash.xxh3_64_intdigest(m.group())
        picked = last is not None and mixed((last * 0x9E3779B97F4A7C15 + h) & MASK) % 5 == 0
        stop = m.group()[-1] in ".!?" or "\n" in gap
        if stop or picked:
            out.append(now)
            stops.append(stop)
            now = []
        last = None if stop else h
    return out, stops


def brute_spans(cut, stops, count=S.SENTENCES, least=S.LEAST_WORDS):
    """The shortest from each start and back from each stop, every length tried."""
    out = set()
    good = lambda i, j: j - i >= count and sum(map(len, cut[i:j])) >= least
    for i in range(len(cut)):
        out |= {(i, j) for j in [next((j for j in range(i + 1, len(cut) + 1) if good(i, j)), None)] if j}
    for j in (k + 1 for k, stop in enumerate(stops) if stop):
        out |= {(i, j) for i in [next((i for i in range(j - 1, -1, -1) if good(i, j)), None)] if i is not None}
    return out


def brute(rows):
    """Sentences removed from each row, from word sequences compared as they are."""
    cuts = [split(r[1] or "") for r in rows]
    seen, gone = {}, defaultdict(set)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        for i, j in sorted(brute_spans(*cuts[k])):
            words = tuple(w for s in cuts[k][0][i:j] for w in s)
            if seen.setdefault(words, (rows[k][0], rows[k][1], i)) != (rows[k][0], rows[k][1], i):
                gone[k] |= set(range(i, j))
    return gone


def cut_of(*texts):
    return S.Cutter().cut(pa.array(texts, pa.string()))


words = st.lists(st.tuples(st.sampled_from([*"abcde", "a.", "b,", "c!", "é", "x;y", "z:"]), st.sampled_from([" ", "  ", "\n", " \n\t", "\t"])), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.sampled_from(["", " ", "\n"]))
def test_cut_and_spans(docs, lead):
    texts = [lead + "".join(w + g for w, g in d) for d in docs]
    c = cut_of(*texts)
    sizes = [[len(s) for s in split(t)[0]] for t in texts]
    assert [int(x) for x in (c.edges[1:] - c.edges[:-1])] == [n for s in sizes for n in s]
    assert [int(x) for x in c.texts[1:] - c.texts[:-1]] == [len(s) for s in sizes]
    first, stop = S.runs(c, 2, 5)
    at, want, words_of = 0, [], []
    for t in texts:
        cut, stops = split(t)
        for i, j in sorted(brute_spans(cut, stops, 2, 5)):
            want.append((at + i, at + j))
            words_of.append(tuple(w for s in cut[i:j] for w in s))
        at += len(cut)
    assert list(zip(first.tolist(), stop.tolist(), strict=True)) == want
    h = list(zip(*(x.tolist() for x in S.run_hashes(c, first, stop)), strict=True))
    assert len(set(zip(h, words_of, strict=True))) == len(set(h)) == len(set(words_of))  # equal hashes if and only if equal words


def sentence(rng, n, end="."):
    return " ".join(rng.choices([f"v{k}" for k in range(400)], k=n)).capitalize() + end


def test_against_brute_force(make, odd_rows):
    rng = random.Random(7)
    passages = [" ".join(sentence(rng, rng.randint(5, 14)) for _ in range(7)) for _ in range(3)] + [sentence(rng, 60), sentence(rng, 30) + " " + sentence(rng, 25)]
    rows = list(odd_rows)
    for i in range(40):
        body = [sentence(rng, rng.randint(3, 15)) for _ in range(8)]
        if i % 2:
            body.insert(rng.randint(0, 8), passages[i % 5])
        rows.append((50 + i, "\n".join(body)))
    rows += [(200, rows[20][1]), (201, passages[0] + "\n" + passages[0]), ((1 << 63) - 1, passages[1]), (None, passages[2])]
    got = S.span_dedup(make(rows)).collect()
    want = brute(rows)
    texts = defaultdict(list)
    for k, r in enumerate(rows):
        texts[(r[0], r[1] or "")].append(len(want.get(k, ())))
    assert len(got) == len(rows)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=order) == sorted(((k[0], n) for k, v in texts.items() for n in v), key=order)
    by = {r.doc_id: r for r in got}
    for i in (51 + 2 * k for k in range(6, 20)):  # a later copy of a passage
        assert by[i].has_repeat
    assert by[200].text == "" and by[52].text == rows[14][1]
    for p in passages:
        assert sum(p in r.text for r in got) == 1


def test_passages_pasted_inside_sentences(make):
    """Of passages of 51 words and more, cut and pasted at any word, hardly any copy but the first stays whole; other texts stay as they are."""
    rng = random.Random(3)
    vocabulary = [f"v{int(rng.paretovariate(0.7))}" for _ in range(5000)]

    def prose(n, stops):
        return [w + (rng.choice(".,.!") if stops and rng.random() < 0.1 else "") for w in rng.choices(vocabulary, k=n)]

    passages = [prose(rng.randint(51, 80), k % 3) for k in range(30)]
    rows, later, clean = [], [], {}
    for i in range(300):
        body = prose(rng.randint(60, 300), i % 4)
        if i % 3:
            at, p = rng.randrange(len(body)), (i // 3) % 30
            if i >= 90:
                later.append((i, p))
            body[at:at] = passages[p]
        else:
            clean[i] = " ".join(body)
        rows.append((i, " ".join(body)))
    got = {r.doc_id: r for r in S.span_dedup(make(rows)).collect()}
    assert sum(got[i].has_repeat for i, _ in later) >= 0.97 * len(later)
    assert sum(got[i].text == t for i, t in clean.items()) == len(clean)
    lost = [sum(x.end - x.start for x in got[i].removed) / len(" ".join(passages[p])) for i, p in later]
    assert sum(lost) / len(lost) > 0.8  # what stays are edges


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=12), st.integers(0, 60), st.integers(0, 60))
def test_spans_within_a_passage_cover_it(sizes, before, after):
    passage = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate(sizes)]
    text = ". ".join(" ".join(w) for w in [["x"] * (before + 1), *passage, ["y"] * (after + 1)]) + "."
    cut = split(text)[0]
    own = [k for k, s in enumerate(cut) if s[0][0] == "p"]
    first, stop = S.runs(cut_of(text))
    inside = {k for i, j in zip(first.tolist(), stop.tolist(), strict=True) if own and i >= own[0] and j <= own[-1] + 1 for k in range(i, j)}
    whole = sum(len(cut[k]) for k in own) >= S.LEAST_WORDS and len(own) >= S.SENTENCES
    assert inside == (set(own) if whole else set())


def test_a_passage_goes_to_its_last_sentence(make):
    rng = random.Random(9)
    rows = []
    for at, sizes in ((0, (40, 15, 10)), (100, (60, 24, 24)), (200, (4, 5, 6, 4, 5, 4, 5))):
        p = " ".join(sentence(rng, n) for n in sizes)
        rows += [(at + i, sentence(rng, 9) + "\n" + p + "\n" + sentence(rng, 11 + i)) for i in range(4)]
    left = {x.doc_id: x for x in S.span_dedup(make(rows)).collect()}
    for i, text in rows:
        own = text.split("\n")
        want = text if i % 100 == 0 else f"{own[0]}\n{own[2]}"
        assert left[i].text == want
    assert left[1].n_removed == left[2].n_removed > 3


def test_ranges_name_what_went(make):
    rng = random.Random(8)
    p = " ".join(sentence(rng, 12) for _ in range(5))
    rows = [(1, p), (2, sentence(rng, 9) + "\n" + p + "\n" + sentence(rng, 9))]
    r = {x.doc_id: x for x in S.span_dedup(make(rows)).collect()}[2]
    t = rows[1][1]
    left = "".join(t[a:b] for a, b in zip([0, *[x.end for x in r.removed]], [*[x.start for x in r.removed], len(t)], strict=True))
    assert left == r.text and p not in left


def test_text_identifiers(spark):
    rng = random.Random(1)
    p = " ".join(sentence(rng, 12) for _ in range(5))
    got = S.span_dedup(spark.createDataFrame([("b", p), ("a", p), (None, p)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.has_repeat) for r in got} == {("a", False), ("b", True), (None, True)}


def test_empty_table(make):
    assert S.span_dedup(make([])).count() == 0
