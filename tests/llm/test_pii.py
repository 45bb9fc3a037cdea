"""Personal data: rules against plain patterns, the tagger's sums and gradients, held-out spans, whole texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from fraudlens.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_ip string"
FORMS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = [int(x) for x in m[0] if x.isdigit()]
            doubled = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            fits = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and doubled % 10 == 0, 8 <= len(digits) <= 15)
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(11)
    return pii.train(pii.labelled_spans([" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(8)) for _ in range(60)]))


def test_rules_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "Z.", "@", "@b", ".c", "1", "25", "256.", "0001", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (606) 555-7814", "x_y%z@h-1.co.uk", "10.0.0.255", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert pii.rule_spans(text) == plain_spans(text), text
    assert pii.rule_spans("a@b.c@d.e@f.g 1.2.3.4.5.6.7.8") == plain_spans("a@b.c@d.e@f.g 1.2.3.4.5.6.7.8")


def test_long_runs_take_linear_time(tagger):
    for text in ("a" * 400_000, "1" * 100_000, "1." * 50_000, "@" * 50_000, "a@" * 50_000, "+1 " + " " * 100_000, "1-" * 50_000, "." * 100_000 + "@b"):
        pii.added_spans(tagger, [text], [pii.rule_spans(text)])


def test_crf_sums_equal_all_sequences():
    rng = np.random.default_rng(0)
    e, m, first = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, moved, total = pii.crf_sums(e, m, first)
    want_p, want_moved = np.zeros_like(p), np.zeros((3, 3))
    for row in range(2):
        scores = {}
        for y in itertools.product(range(3), repeat=4):
            scores[y] = first[y[0]] + sum(e[t, row, y[t]] for t in range(4)) + sum(m[a, b] for a, b in zip(y, y[1:]))
        whole = np.log(sum(map(np.exp, scores.values())))
        assert np.isclose(total[row], whole)
        for y, s in scores.items():
            share = np.exp(s - whole)
            for t in range(4):
                want_p[t, row, y[t]] += share
            for a, b in zip(y, y[1:]):
                want_moved[a, b] += share
    assert np.allclose(p, want_p) and np.allclose(moved, want_moved)


def test_gradients():
    rng = np.random.default_rng(1)
    tagger = pii.Tagger.begun(3, np.float64)
    ids = rng.integers(0, pii.SYMBOLS, (3, 7))
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [7, 8, 8, 1, 1, 2, 0]])
    _, grads = tagger.loss(ids, tags)
    for name, w in tagger.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "moves" and not pii.allowed()[at]:
                continue
            kept = w[at]
            w[at] = kept + 1e-5
            more = tagger.loss(ids, tags)[0]
            w[at] = kept - 1e-5
            less = tagger.loss(ids, tags)[0]
            w[at] = kept
            assert np.isclose((more - less) / 2e-5, grads[name][at], atol=1e-6), name


def test_held_out_spans(tagger):
    """Spans that the rules miss, with other words and numbers than those learned from."""
    held = pii.labelled_spans(["some other words stand here again and again"], 800, seed=99)
    texts = [text for text, _ in held]
    ruled = [pii.rule_spans(text) for text in texts]
    added = pii.added_spans(tagger, texts, ruled)
    wanted = {(i, x) for i, (_, spans) in enumerate(held) for x in spans if x not in ruled[i]}
    found = {(i, x) for i, spans in enumerate(added) for x in spans}
    assert len(wanted) > 150 and len(wanted & found) > 0.75 * len(wanted) and len(wanted & found) > 0.9 * len(found)


def test_overlapping_windows_agree(tagger):
    """A span is found wherever it stands in its text, on a window's edge or not."""
    for at in range(0, 150, 7):
        text = ("stone hinder or aleri the " * 8)[:at] + " (606) 555-7814 shore" + " treason delight" * 9
        got = [text[a:b] for kind, a, b in pii.added_spans(tagger, [text], [[]])[0] if kind == 3]
        assert got == ["(606) 555-7814"], at
    tags = np.array([0, 1, 2, 2, 1, 2, 4, 4, 0, 8, 0])
    assert pii.spans_of_tags(tags) == [(0, 1, 4), (0, 4, 6), (1, 6, 8), (3, 9, 10)] and pii.spans_of_tags(np.array([0, 0])) == []
    texts = [text, "1" * 200, "", "no sign", text]
    assert [(i, o, t.tolist()) for i, o, t in pii.tagged_stretches(tagger, texts)] == [(i, o, t.tolist()) for i, o, t in pii.tagged_stretches(tagger, texts, batch=1)]


def test_windows_hold_all_signs():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abc      9@" if rng.random() < 0.03 else "ab ") for _ in range(rng.randrange(0, 400)))
        starts = pii.window_starts(text)
        assert starts == sorted({s for s in range(0, len(text), pii.STRIDE) if re.search("[0-9@]", text[s : s + pii.WINDOW])})


def test_whole_query(spark, tagger):
    rows = [(0, None), (1, ""), (2, "mail a.b@c.org or 10.0.0.1, 4111 1111 1111 1111, +1 (606) 555-7814"), (None, "x" * 70_000 + " é 😀 z@y.com"), (2, "repeated a@b.cd"), (2, "repeated a@b.cd"), (5, "clean text, chapter 12 of 2019")]
    frame = spark.createDataFrame([(i, t, "s", "n") for i, t in rows], SCHEMA).repartition(3)
    out = pii.personal_data(frame, tagger=tagger).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out)
    want = []
    for i, text in rows:
        spans = plain_spans(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        want.append((str(i), *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want)
    by_id = {r.doc_id: r.spans for r in out}
    assert by_id[0] == by_id[1] == by_id[5] == "" and by_id[2] is not None and "email:70005:70012" in by_id[None]
    assert pii.personal_data(frame.limit(0)).count() == 0
