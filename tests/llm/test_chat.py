import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same

from quire.llm import chat
from quire.llm.queries import ORACLE_SQL, PROBE, QUERIES

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", "]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "as[/ROLE]sistant"]), PIECES), min_size=1, max_size=5))
def test_read_back(turns):
    show = chat.compile_template(chat.TEMPLATE, chat.CONSTANTS)
    messages = lambda: ({"role": r, "text": t} for r, t in turns)
    whole = "".join(p for p, _ in chat.parts(show(messages())))
    n, digest, loss_chars, loss, chars = chat.read_back(chat.parts(show(messages())))
    said = "".join(t for r, t in turns if r == "assistant")
    assert n == len(turns) and chars == len(whole) and loss_chars == len(said)
    assert digest == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert loss == hashlib.sha256(said.encode()).hexdigest()


def render(template, messages, **constants):
    return "".join(p for p, _ in chat.parts(chat.compile_template(template, constants)(iter(messages))))


def test_language():
    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for x in messages %}{{ loop.index }}{{ x.text | trim | upper }}{% if not loop.last %}, {% endif %}{% endfor %}!", m) == "1HI, 2YO!"
    assert render("{% set a = 'x' ~ 1 %}{{ a }}{% if a == 'x1' and true %}y{% elif a %}z{% else %}w{% endif %}", m) == "x1y"
    assert render("{{ nothing.at }}{{ nothing }}", m) == ""


def test_folding_leaves_no_constant_work():
    nodes = chat.fold(chat.parse("a{{ 'b' | upper }}{% if bos == 'q' %}x{% else %}{{ bos }}{% endif %}c"), {"bos": "-"})
    assert nodes == [("print", ("const", "aB-c"))]


@pytest.mark.parametrize("bad", ["{{ a.b.c() }}", "{{ a.__class__ }}", "{{ 'x' | eval }}", "{% for x in y %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ 1 + }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.parse(bad)


def test_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, None, "a"), (None, 1, "user", "n"), (2, None, "user", "x"), (2, None, "user", "x"), (3, 1, "assistant", PROBE * 500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"\na\nuser\n\nassistant\nb\n").hexdigest()
    assert got[2].n_turns == 2 and got[None].n_turns == 1
    assert got[3].loss_sha256 == hashlib.sha256((PROBE * 500).encode()).hexdigest()
    parts = chat.render(df).where("conv_id = 3").collect()
    assert [p.text[s.start : s.end] for p in parts for s in p.loss] == [chat.escape(PROBE * 500)]
    assert chat.digests(df.limit(0)).count() == 0


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", 7, "x", 0), (1, 2, "assistant", "b" * 3_000_000, 8, "y", 1)], "conv_id long, turn long, role string, text string, n_turns int, loss string, part int")
    own = df.select("conv_id", "turn", "role", "text")
    assert chat.digests(df).collect() == chat.digests(own).collect() and chat.render(df).collect() == chat.render(own).collect()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op2_chat_template"](spark, sf), ORACLE_SQL["op2_chat_template"], sf)
