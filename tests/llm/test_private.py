import random
import re
import time

import pytest

from plumbline.llm import private

VERBATIM = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, pattern in VERBATIM.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            odd = sum(digits[::-1][::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[::-1][1::2])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_plain_spans_equal_the_verbatim_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@", ".", "..", "+1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", " ", "-", "--", "é", "_", "(0)", "+44 20 7946 0958", "x@y.z", "\n", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert private.plain_spans(text) == slow(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane.doe [at] mail [dot] example (dot) org, soon", "email", "jane.doe [at] mail [dot] example (dot) org"),
        ("write to jane at example dot org", "email", "jane at example dot org"),
        ("jаne@example.org", "email", None),
        ("jane@exаmple.оrg now", "email", "jane@exаmple.оrg"),
        ("É ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ!", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
        ("call plus four four two zero seven nine four six zero nine five eight please", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("host 10[.]0[.]0[.]7 is up", "ip", "10[.]0[.]0[.]7"),
        ("card ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises(text, kind, source):
    plain = private.plain_spans(text)
    added = private.disguised_spans(text, plain)
    if source is None:
        assert plain and not added
    else:
        assert [(k, text[a:b]) for k, a, b in added] == [(kind, source)]


@pytest.mark.parametrize("text", ["look at example.com", "meet at the dot", "one two three four", "dot dot dot", "At one. Dot five (at) six", "the dog at home dot", "x" * 50_000, "1" * 50_000, "+" * 1000 + "1 " * 20_000])
def test_clean_texts(text):
    assert private.disguised_spans(text, private.plain_spans(text)) == []


def test_rewriting_maps_back():
    text = "aé（b） five-six [at] x​y"
    seen, starts, ends = private.rewrite(text)
    assert len(seen) == len(starts) == len(ends) and seen == "aé(b) 56@xy"
    assert starts == sorted(starts) and all(a < b for a, b in zip(starts, ends))


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a@b.c +1 234 567 890", "k"), (1, "a@b.c +1 234 567 890", "k"), (None, None, None), (2, "", "")], "doc_id int, text string, spans string")
    rows = sorted(private.find_identifiers(docs).collect(), key=repr)
    assert [len(r["spans"]) for r in rows if r["doc_id"] == 1] == [2, 2] and len(rows) == 4
    assert private.find_identifiers(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("host 10.0.0.one is up", "ip", "10.0.0.one"),
        ("host one.two.three.four is up", "ip", "one.two.three.four"),
        ("call +one 415 555 0100 now", "phone", "+one 415 555 0100"),
        ("call plus one 415 555 0100 now", "phone", "plus one 415 555 0100"),
        ("host 10.0.0.ſix or 10.0.0.fıve, fİve ſeven", "ip", "10.0.0.ſix"),
    ],
)
def test_a_lone_word_is_looked_at(text, kind, source):
    added = [(k, text[a:b]) for k, a, b in private.disguised_spans(text, private.plain_spans(text))]
    assert (kind, source) in added
    other = text + " | two three [at]"
    assert [(k, other[a:b]) for k, a, b in private.disguised_spans(other, private.plain_spans(other))] == added


def test_gate_and_transducer_agree():
    rng = random.Random(3)
    pieces = [*private.DIGIT_WORDS, *private.SIGN_WORDS, "One", "ſix", "at", "dot", "Dot", "[", "]", "(", "}", "<", "@", ".", " ", " ", "\n", "-", "+", "1", "415", "10.0.0", "4111 1111 1111 111", "x", "é", "а", "Һ", "１", "​", "_"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        plain = private.plain_spans(text)
        seen, starts, ends = private.rewrite(text)
        every = [(k, starts[a], ends[b - 1], seen[a:b]) for k, a, b in private.plain_spans(seen)]
        every = [(k, a, b) for k, a, b, shown in every if shown != text[a:b] and not any(k == q and a < y and x < b for q, x, y in plain)]
        assert private.disguised_spans(text, plain) == every, text
        found += len(every)
    assert found > 50


@pytest.mark.parametrize("filler", [" ", "\t", "\n ", "[", "[ ", "( at", " dot", "one ", "+1 ", "a at ", "@", "1 "])
def test_long_texts_of_one_kind_take_no_square(filler):
    def seconds(n: int) -> float:
        text = "one at x [at] y" + filler * n + "plus one"
        began = time.process_time()
        private.disguised_spans(text, private.plain_spans(text))
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 5 * seconds(50_000) + 0.5


def test_forms_after_each_other():
    text = "joe [at]  (at) mail [dot] [at] x"
    assert private.rewrite("joe [at] [dot] x")[0] == "joe@.x"
    assert private.rewrite(text)[0] == "joe@@mail.@x"
