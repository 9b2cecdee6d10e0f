"""The template language: syntax, folding, sandbox, and conversations there and back."""

import hashlib
from collections import Counter

import pytest

from wheelmark.llm import chat
from wheelmark.llm.template import Choice, Const, Generation, Name, Output, Template, TemplateError, Text, fold, parse


def said(source, messages=(), **kw):
    return "".join(t for t, _ in Template(source).render([{"role": r, "text": t} for r, t in messages], **kw))


@pytest.mark.parametrize(
    "source, want",
    [
        ("{{ 1 + 2 * 3 - 4 // 3 }}", "6"), ("{{ 'a' ~ 1 ~ none }}", "a1"), ("{{ 'x' if 1 > 2 else 'y' }}", "y"), ("{{ 'b' in 'abc' and not 'z' in 'abc' }}", "True"),
        ("{{ '  q ' | trim | upper }}|{{ 'abc'[1:] }}|{{ 'abc'[-1] }}", "Q|bc|c"), ("{% for k in range(3) %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", "1,2,3"),
        ("{% for k in [] %}x{% else %}none{% endfor %}", "none"), ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"), ("{# gone #}{{ missing is defined }}{{ v | default('d') }}", "Falsed"),
        ("{% set n = namespace(k=0) %}{% for x in [1, 2, 3] %}{% set n.k = n.k + x %}{% endfor %}{{ n.k }}", "6"), ("{% set a = 1 %}{% for x in [1] %}{% set a = 2 %}{% endfor %}{{ a }}", "1"),
        ("{% if false %}a{% elif 1 == 1 %}b{% else %}c{% endif %}", "b"), (r"{{ 'it\'s\n' }}", "it's\n"), ("{{ 'a,b'.split(',') | join('-') }}", "a-b"), ("{{ [1, 'a'] | tojson }}", '[1, "a"]'), ("{{ 7 is odd and 'x' is string and none is none }}", "True"),
    ],
)
def test_what_templates_say(source, want):
    assert said(source) == want


@pytest.mark.parametrize(
    "source",
    ["{{ x.__class__ }}", "{{ open('f') }}", "{{ 'a'.format(1) }}", "{% if true %}", "{% endfor %}", "{{ 1 + }}", "{{ 'a' * 9 }}", "{{ x | eval }}", "{% for k in range(100000000) %}{% endfor %}", "{{ raise_exception('no') }}", "{% import x %}", "{{ _steps }}",
     "{% set n = namespace(s='ab') %}{% for k in range(60) %}{% set n.s = n.s ~ n.s %}{% endfor %}", "{% for a in range(9999) %}{% for b in range(9999) %}{% endfor %}{% endfor %}"],
)
def test_sandbox(source):
    with pytest.raises(TemplateError):
        said(source)


def test_folding():
    tree = fold(parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}{{ x }}{% else %}d{% endif %}{{ 1 + y }}{% for k in [] %}z{% endfor %}{{ true and y }}"))
    assert tree[0] == Text("abcd") and tree[2] == Output(Name("y")) and len(tree) == 3
    assert isinstance(fold(parse("{{ raise_exception('x') if c }}"))[0].value, Choice)  # not called while folding
    assert fold(parse("{% generation %}{{ 2 * 3 }}{% endgeneration %}"))[0] == Generation((Text("6"),))
    assert isinstance(fold(parse("{{ 1 // 0 }}"))[0].value, object) and fold(parse("{{ ('a','') }}".replace("('a','')", "'a'")))[0] == Text("a")
    assert Const(1) == Const(1)


def test_messages_are_read_as_a_stream_where_that_is_enough():
    seen = []

    def messages(n):
        for k in range(n):
            seen.append(k)
            yield {"role": "user", "text": str(k)}

    one = Template("{% for m in messages %}{{ m.text }}{% if loop.last %}!{% endif %};{% endfor %}")
    out = one.render(messages(1000))
    assert one.streams and next(out) == ("0", False) and len(seen) == 2
    assert "".join(t for t, _ in out).endswith("999!;")
    for source, want in (("{{ messages[0].text }}{% for m in messages %}{{ m.text }}{% endfor %}", "0012"), ("{% for m in messages[1:] %}{{ m.text }}{% endfor %}", "12"), ("{{ messages | length }}{{ messages[-1].text }}", "32"), ("{% for m in messages %}{% for n in messages %}{{ n.text }}{% endfor %}{% endfor %}", "012" * 3)):
        assert "".join(t for t, _ in Template(source).render(messages(3))) == want


def test_escapes_are_reversible():
    for text in ("", "<|im_end|>", "<|", "<\\|", "<\\\\\\|x<|", "<<|<", "a<\\", "|<|||"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        name = f"{text}\n\\n"
        assert "\n" not in chat.escape_name(name) and chat.unescape_name(chat.escape_name(name)) == name


ODD = [
    (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx<\\|", "clash"), (1, 0, "user", None, "clash"), (1, 1, "assistant", "again", "clash"), (1, 1, "assistant", "again", "clash"), (1, None, "system", "first", "clash"),
    (2, 0, None, "né\U0001f600", "clash"), (None, 0, "user\n<|", "a", "clash"), (None, 1, "assistant", "", "clash"), (3, 0, "assistant", "x" * 300_000 + "<", "clash"), (3, 1, "assistant", "|>", "clash"),
]


def test_conversations_there_and_back(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string, piece string").repartition(3)
    formatted = chat.format_conversations(rows)
    want = {}
    for conv in {r[0] for r in ODD}:
        own = sorted([r for r in ODD if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_name(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole), whole)
    for ordered in (True, False):
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted.repartition(4) if not ordered else formatted, ordered=ordered).collect()}
        assert got == {k: v[:5] for k, v in want.items()}
    texts: dict = {}
    for r in sorted(formatted.collect(), key=lambda r: r.piece):
        assert r.start == len(texts.get(r.conv_id, ""))
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
    assert texts == {k: v[5] for k, v in want.items()}
    assert chat.read_back(chat.format_conversations(rows.limit(0)), ordered=True).isEmpty()


def test_other_templates_and_bad_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    source = "{% for m in messages %}[{{ m.role }}] {% if m.role == 'assistant' %}{% generation %}{{ m.content }}{{ eos }}{% endgeneration %}{% else %}{{ m.content }}{% endif %}\n{% endfor %}{% if add_generation_prompt %}[assistant] {% endif %}"
    got = chat.format_conversations(rows, source, eos="</s>", add_generation_prompt=True).orderBy("piece").collect()
    assert [(r.text, r.loss) for r in got] == [("[user] hi\n[assistant] ", False), ("yo</s>", True), ("\n[assistant] ", False)]
    with pytest.raises(Exception, match="expected"):
        chat.read_back(chat.format_conversations(rows, source)).collect()
    assert Counter(r.conv_id for r in got) == {1: 3}
