"""License scans, chat formatting, packing, edited counts and personal data against brute force and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from causalspark.llm import chat, edited_counts, licenses, packing, pii
from causalspark.llm.segments import byte_bpe

SCHEMA = "doc_id long, text string, w string, at string, n_words string, found string, base string, h long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(d, t, "w", "a", "n", "f", "b", 1) for d, t in rows], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- licences

WORD = re.compile(licenses.WORD)


def brute_licenses(rows):
    out = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        found = []
        for tm in licenses.TEMPLATES:
            for s in range(-len(tm.words), len(w)):
                right = [j for j, x in enumerate(tm.words) if 0 <= s + j < len(w) and w[s + j] == x]
                if set(tm.must) <= set(right) and len(right) / len(tm.words) >= licenses.LEAST_SHARE:
                    found.append((tm.label, tm.base, s, len(right) / len(tm.words)))
        base = [f for f in found if f[1]]
        out.append((d, len(w), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None),
                    ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0)))
    return sorted(out, key=str)


def test_scan_licenses(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "CC BY cc-by Cc. By"), (4, "cc by nc"),
            (5, "Licensed under CC BY-NC 4.0. All rights\nreserved. all rights rights reserved"), (6, "general public general public license " * 3),
            (7, "license " * 3000 + "This work is licensed under the GNU General Public License, version 3."), (8, "mit license"), (9, "é MIT Lİcense ünder the"),
            (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"),
            (11, "Permission is hereby granted, free of charge, software and associated documentation files"), (12, "rights reserved all rights reserved all")]
    assert rows_of(licenses.scan_licenses(docs(spark, rows))) == brute_licenses(rows)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[3] == "mit" and got[5] == "cc-by,cc-by-nc,reserved" and got[7] == "gpl,gpl-3.0" and got[10] == "mit"


def test_scan_is_native(spark):
    plan = licenses.scan_licenses(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# ---------------------------------------------------------------- chat

def digests(rows):
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


NASTY = ["", None, "\\", "\\\\<s>", "<|turn|>assistant\nhi<|end|>\n", "</s>[INST] ok [/INST]", "<<<s>>", "<|end|", "<", "[", "é\U0001f600 \\n", "x" * 100_000, "<\\|end|>", "a\n\nb"]


def test_format_digests(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\", "<|end|>"]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, None, "user", "z"), (7, 0, "assistant", "tie"), (7, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, formatted string")
    probe = [(-1, 0, "user", NASTY[5]), (-1, 1, "assistant", NASTY[5])]
    got = chat.format_digests(chat.with_probe(df))
    assert [r[:5] for r in rows_of(got)] == digests(rows + probe)
    parts = {}
    for r in sorted(chat.formatted_turns(chat.with_probe(df)).collect(), key=lambda r: (str(r.conv_id), r.part)):
        parts.setdefault(r.conv_id, []).append(r.formatted)
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == {c: len("".join(p)) for c, p in parts.items()}
    empty = spark.createDataFrame([], df.schema)
    assert chat.format_digests(empty).count() == 0 and [r.conv_id for r in chat.format_digests(chat.with_probe(empty)).collect()] == [-1]


def test_escape_hides_control_strings():
    rng = random.Random(2)
    pieces = ["\\", "<", "[", ">", "]", "|", "end", *chat.CONTROL]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 8)))
        hidden = chat.escape(text)
        assert not any(c in hidden for c in chat.CONTROL) and chat.unescape(hidden) == text


def render(template, **context):
    pieces = list(chat.compile_template(template)(context))
    return "".join(p for p, _ in pieces), "".join(p for p, marked in pieces if marked)


def test_template_language():
    assert render("a{{ 'b' ~ (1 + 1) }}{# no #}c")[0] == "ab2c"
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.first %}F{% elif loop.last %}L{% else %}-{% endif %}{{ m['role'] | upper }};{% endfor %}",
                  messages=[{"role": "a"}, {"role": "b"}, {"role": "c"}])[0] == "1FA;2-B;3LC;"
    assert render("{% if not x and 'a' in y or false %}yes{% else %}no{% endif %}", x="", y="cat")[0] == "yes"
    assert render("{{ nothing.at.all }}|{% generation %}{{ t | trim }}{% endgeneration %}|", t=" x ") == ("|x|", "x")
    assert render("{{ \"}} %}\" }}")[0] == "}} %}"


def test_template_folds_constants():
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == (chat.Output(chat.Const("abcd")),)


@pytest.mark.parametrize("bad", ["{% for x in %}{% endfor %}", "{% if x %}", "{{ x.__class__ }}", "{{ f(x) }}", "{{ x | evil }}", "{% include 'x' %}", "{{ 1 + }}", "{% endif %}"])
def test_template_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


# ---------------------------------------------------------------- packing

def slow_fit(lengths, capacity):
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [r for r in range(len(rows)) if rooms[r] >= lengths[i]]
        if not fitting:
            rooms.append(capacity)
            rows.append([])
            fitting = [len(rows) - 1]
        best = min(fitting, key=lambda r: rooms[r])
        rooms[best] -= lengths[i]
        rows[best].append(i)
    return sorted(rooms)


def test_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randrange(0, capacity + 1) for _ in range(300)]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(300))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == slow_fit(lengths, capacity)


def test_packed_rows_are_lossless(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "naïve", "sat\n\n", "42", "  x!\x1c!"]) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 5000), (None, "no id"), (7, rows[7][1])]
    packed = packing.packed_rows(docs(spark, rows), length=128, lot_tokens=3000)
    coding = byte_bpe()
    for r in packed.collect():
        ids = packing.id_matrix([r.input_ids])[0]
        assert len(ids) == 128 and r.n_tokens == r.cu_seqlens[-1] <= 128 and list(r.resets) == list(r.cu_seqlens[:-1])
        assert r.n_segments == len(r.doc_ids) == len(r.doc_offsets) == len(r.resets) and (ids[r.n_tokens:] == packing.PAD).all()
        at = packing.position_ids(r.cu_seqlens, 128)
        assert all((at[s:e] == np.arange(e - s)).all() for s, e in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    pieces = {}
    for r in packing.unpack(packed).collect():
        pieces.setdefault(r.doc_id, []).append((r.doc_offset, r.ids))
    for d, t in rows:
        want = coding.encode_ordinary(t or "")
        times = sum(x == d for x, _ in rows)
        assert sorted(pieces[d]) == sorted([(o, want[o:o + 128]) for o in range(0, max(1, len(want)), 128)] * times)
    assert packing.packed_rows(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- edited counts

def test_count_tree_follows_edits():
    rng, count, coding = random.Random(5), edited_counts.counter(), byte_bpe()
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "'s", "é", "1", "!!", "\x1c", "\x85", "　", "word", " the"]
    text_of = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for k in range(150):
        text = text_of(rng.randrange(0, 400))
        tree = edited_counts.CountTree(text, count)
        assert tree.n_tokens == len(coding.encode_ordinary(text))
        for _ in range(12):
            start = rng.randrange(-2, len(text) + 5)
            end = start + rng.choice([0, 0, 1, 3, 30, 200, -4])
            new = text_of(rng.choice([0, 1, 2, 40]))
            tree.edit(start, end, new)
            s = max(0, min(start, len(text)))
            text = text[:s] + new + text[max(s, min(end, len(text))):]
            assert tree.text() == text and tree.n_chars == len(text) and tree.n_tokens == len(coding.encode_ordinary(text)), (k, start, end, new)


def test_edits_touch_little():
    tree = edited_counts.CountTree("some words here " * 20_000, edited_counts.counter())
    tree.edit(100_000, 100_003, "X")
    assert tree.encoded < 60


def apply(text, edits):
    for s, e, new in edits:
        text = text[:s] + new + text[e:]
    return text


def test_edited_counts(spark):
    rows = [(1, None), (2, ""), (3, "same line\nother!!! line\nsame line\nsame line"), (3, "x"), (None, "a|||b\n\n\n"), (4, "w##$$ " * 30_000 + "\nend\nend\n")]
    coding = byte_bpe()
    want = []
    for d, t in rows:
        edits = edited_counts.repeated_line_edits(t or "")
        after = apply(t or "", edits)
        want.append((d, len(coding.encode_ordinary(t or "")), len(t or ""), len(edits), len(coding.encode_ordinary(after)), len(after)))
    assert apply(rows[2][1], edited_counts.repeated_line_edits(rows[2][1])) == "same line\nother! line\nsame line"
    got = edited_counts.edited_counts(docs(spark, rows))
    assert [r[:6] for r in rows_of(got)] == sorted(want, key=str)
    given = spark.createDataFrame([(1, "hello world", [(0, 5, "bye"), (3, 99, None)]), (2, "x", None), (3, None, [(None, None, "new text")])],
                                  "doc_id long, text string, changes array<struct<start:int,end:int,replacement:string>>")
    assert [(r[0], r[3], r[5]) for r in rows_of(edited_counts.edited_counts(given, "changes"))] == [(1, 2, 3), (2, 0, 1), (3, 1, 8)]
    assert edited_counts.edited_counts(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_plain_spans_are_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", "@x.com", ".", "1", "255", "256", "1.2.3.4", " ", "-", "+1 (017) 555-7713", "4111111111111111", "4111 1111 1111 1111", "+", "(", "é", "%", "0000"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))
        assert pii._order(pii.plain_spans(text)) == pii._order(brute_spans(text)), text


def test_detectors_are_linear():
    for text in ("1" * 200_000, "x" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "one " * 50_000, "[ at " * 40_000):
        pii.find_pii(text)


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("mail joe [at] example [dot] com now", "email", "joe [at] example [dot] com"), ("mail joe(at)example(dot)co(dot)uk", "email", "joe(at)example(dot)co(dot)uk"),
    ("joe at example dot com is it", "email", "joe at example dot com"), ("jоe@exаmple.com", "email", "jоe@exаmple.com"), ("ｊｏｅ＠ｅｘ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘ．ｃｏｍ"),
    ("call five five five, one two three four five now", "phone", "five five five, one two three four five"),
    ("call plus one five five five one two three four", "phone", "plus one five five five one two three four"),
    ("call (five-five-five.one two three, four oh)!", "phone", "five-five-five.one two three, four oh"),
    ("ip １９２.168.1.1 here", "ip", "１９２.168.1.1"), ("no jo​e@ex​ample.com x", "email", "jo​e@ex​ample.com"),
])
def test_disguises(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.find_pii(text)[1]


@pytest.mark.parametrize("part", [
    "joe at example dоt com", "joe at example d\u200bot com", "joe аt example dot com", "joe a\u200bt example \u200bdot\u200b com", "joe ａｔ example ｄｏｔ com", "jоe\u2003at\u2003example\u2003dot\u2003com",
    "joe at example\u00addot com".replace("\u00ad", " \u00ad"), "joe ［at］ example ［dot］ com", "joe (аt) example (dоt) com",
])
def test_composed_disguises(part):
    """Look-alikes and invisible characters inside "at", "dot" and their brackets."""
    text = f"mail {part}, now"
    assert ("email", 5, 5 + len(part)) in pii.find_pii(text)[1]


@pytest.mark.parametrize("part", [
    "joe [at] firma [dot] it", "joe (at) firma (dot) pizza", "joe (at) firma.pizza", "joe at firma [dot] pizza", "joe (at) firma dot pizza", "joe@firma dot pizza",
    "joe at firma dot us", "joe at firma dot in", "joe at firma dot xyz", "joe at mail dot firma dot co dot za", "joe at example.com", "j.doe at mail.firma.at",
    "joe at mail.firma dot it", "jоe аt firma.it",
])
def test_last_labels(part):
    text = f"mail {part}, now"
    assert ("email", 5, 5 + len(part)) in pii.find_pii(text)[1]


@pytest.mark.parametrize("sign", ["x (at) home", "one dot two", "[at]", "look at this.thing"])
def test_label_test_is_of_a_span(sign):
    """Signs elsewhere in the text do not take away an address in look-alikes."""
    text = "mail joe＠firma.pizza now; " + "words " * 50 + sign + " end"
    assert ("email", 5, 20) in pii.find_pii(text)[1]


@pytest.mark.parametrize("text", ["see it at www.example.com now", "read at example.com/page", "We were at home.It was late", "at 10.30 or at 1.2.3", "look at this.thing"])
def test_hosts_in_prose(text):
    assert pii.find_pii(text) == ([], [])


def test_cheap_checks_miss_nothing():
    """What the cheap checks rule out, the transducers would not find either."""
    rng = random.Random(8)
    pieces = ["one", "Two", "oh", "nine", "three", "plus", " ", ", ", "-", ".", "(", ")", "x", "é", "!", "\n", "５", "\u200b", "а", " dot ", " at ", "[at]", "(dot)", "com"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(10, 30)))
        assert pii._has_spelled(text.lower()) or not pii._SPELLED.search(text), text
        assert pii._has_looks(text) == any(c in pii._TABLE for c in text)
    spelled = "call " + " ".join(["five"] * 9) + "!"
    assert pii._has_spelled(spelled)


@pytest.mark.parametrize("text", ["We met at the dot on the map, at one or two.", "one two three", "é à la carte at noon", "arrays[at] and (dot) products", "Привет, как дела?"])
def test_clean_texts_stay_clean(text):
    assert pii.find_pii(text) == ([], [])


def test_pii_spans(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co 1.2.3.4 +1 (017) 555-7713"), (3, "a@b.co 1.2.3.4 +1 (017) 555-7713"), (None, "joe [at] ex [dot] com"), (4, "x" * 100_000 + " a@b.co")]
    got = rows_of(pii.pii_spans(docs(spark, rows)))
    want = []
    for d, t in rows:
        base, found = pii.find_pii(t or "")
        assert base == pii._order(brute_spans(t or ""))
        join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        want.append((d, *[sum(k == x for k, _, _ in base) for x in pii.KINDS], hashlib.sha256(join(base).encode()).hexdigest(), join(found), len(found) - len(base)))
    assert got == sorted(want, key=str)
    assert [r.text for r in pii.redact(docs(spark, rows[2:3])).collect()] == ["[email] [ip] [phone]"]
    assert pii.pii_spans(docs(spark, [])).count() == 0
