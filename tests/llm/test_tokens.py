"""Attributed tokens against a walk over single tokens."""

import random

import pytest

from strandline.llm.tokens import RULES, Attribution, encoding, token_counts

SCHEMA = "doc_id long, text string, title string, field string, n_tokens string"
BITS = ["word", " and", "\n", "\n\n", "  ", "日本語", "é", "🙂", "'s", "123", "\t", "x" * 40, "\r\n", ".", "####"]


def corpus():
    r = random.Random(4)
    rows = [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 60))), r.choice([None, "", "a title\nof two"]), "c", "c") for i in range(60)]
    return rows + [(None, None, None, "", ""), (7, "", "", "", ""), (7, "", "", "", ""), (99, "\n", "x", "", ""), (100, "ab " * 20000, None, "", "")]


def brute(how, values):
    """(field, chars, tokens) by section, one token and one byte at a time."""
    tokenizer, _ = encoding(how)
    spans, owner = [], []
    for i, v in enumerate(values):
        lines = (v or "").split("\n") if how.lines else [v or ""]
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 or i + 1 < len(values) else [])
        if i + 1 < len(values):
            lines[-1] += how.joiner
        for x in lines:
            owner += [len(spans)] * len(x.encode())
            spans.append([how.fields[i], x, 0.0])
    text = how.joiner.join(v or "" for v in values)
    at = 0
    for t in tokenizer.encode_ordinary(text):
        own = owner[at : at + len(tokenizer.decode_single_token_bytes(t))]
        at += len(own)
        share = {s: own.count(s) for s in sorted(set(own))}
        if how.rule == "split":
            for s, k in share.items():
                spans[s][2] += k / len(own)
        else:
            spans[{"first": own[0], "last": own[-1], "most": max(share, key=share.get)}[how.rule]][2] += 1
    assert at == len(text.encode())
    out, c = [], 0
    for n, (f, x, k) in enumerate(spans):
        out.append((f, n, c, c + len(x), round(k, 9)))
        c += len(x)
    return out


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("fields,lines", [(("text",), True), (("title", "text"), True), (("title", "text"), False)])
def test_brute(spark, rule, fields, lines):
    how = Attribution(rule=rule, fields=fields, lines=lines)
    rows = corpus()
    out = token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), how).collect()
    want = [(str(r[0]), *x) for r in rows for x in brute(how, [r[1] if f == "text" else r[2] for f in fields])]
    assert sorted((str(r.doc_id), r.field, r.section, r.char_start, r.char_end, round(r.n_tokens, 9)) for r in out) == sorted(want)


def test_empty_and_rule(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        token_counts(spark.createDataFrame([], SCHEMA), Attribution(rule="none"))
