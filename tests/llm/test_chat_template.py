import pickle

import pytest

from tidemark.llm.chat_template import Const, Template, TemplateError, Write

MESSAGES = [{"role": "system", "text": " Be kind. "}, {"role": "user", "text": "Hi"}, {"role": "assistant", "text": "Hello"}, {"role": "user", "text": "Bye"}]


def shown(source, messages=MESSAGES, **constants):
    return Template(source, constants, {"shout": lambda x: x.upper() + "!"}).render(messages)[0]


@pytest.mark.parametrize(
    "source, want",
    [
        ("plain {# no #}text", "plain text"),
        ("{% for m in messages %}{{ loop.index }}/{{ loop.length }}{{ m.role }};{% endfor %}", "1/4system;2/4user;3/4assistant;4/4user;"),
        ("{% for m in messages %}{% if loop.first %}[{% endif %}{{ m['text'] | trim | shout }}{% if not loop.last %}, {% else %}]{% endif %}{% endfor %}", "[BE KIND.!, HI!, HELLO!, BYE!]"),
        ("a {%- set x = 'b' ~ 1 + 2 -%} c{{ x }}", "acb3"),
        ("{% set who = 'me' %}{% for m in messages %}{% if m.role in 'user' and loop.index0 > 1 or m.role == 'system' %}{{ who }}{% set who = 'you' %}{{ who }}{% elif m.role != 'user' %}-{% endif %}{% endfor %}{{ who }}", "meyou-meyoume"),
        ("{{ 'yes' if n > 3 else 'no' }}{{ -n + 1 }}{{ none }}{{ true }}{{ 'it\\'s\\n' }}", "yes-4true" + "it's\n"),
        ("{{ unknown | default('none given') }}{{ 'abc' | length }}{{ 'a' not in 'bc' }}{{ not not n }}", "none given3truetrue"),
        ("{{ (1 == 1) and 'x' or 'y' }}{{ 5 - 2 - 1 }}", "x2"),
    ],
)
def test_renders(source, want):
    assert shown(source, n=5) == want


def test_generation_spans_count_code_points():
    t = Template("é{% for m in messages %}<{% if m.role == 'assistant' %}{% generation %}{{ m.text }}é{% endgeneration %}{% endif %}>{% endfor %}")
    text, spans = t.render(MESSAGES)
    assert text == "é<><><Helloé><>" and [text[a:b] for a, b in spans] == ["Helloé"]


def test_parts_of_a_conversation_join_to_the_whole():
    t = Template("{% set x = 'b' %}begin {% for m in messages %}{{ x }}{{ loop.index }}{% if loop.last %}last{% endif %}{{ m.text }}{% endfor %} end{{ x }}")
    whole = t.render(MESSAGES)[0]
    for cut in range(1, 4):
        assert t.render(MESSAGES[:cut], 0, 4)[0] + t.render(MESSAGES[cut:], cut, 4)[0] == whole
    assert t.render([])[0] == "begin  endb"


def test_constants_fold_away():
    tree = Template("{{ bos }}a{% if bos == '<s>' %}b{{ 'c' | upper }}{% else %}{{ x }}{% endif %}{% if false %}no{% elif 1 > 0 %}d{% endif %}{{ 1 + 2 }}", {"bos": "<s>"}).tree
    assert tree == (Write(Const("<s>abCd3")),)


def test_tasks_compile_their_own_closures():
    t = pickle.loads(pickle.dumps(Template("{{ bos }}{% for m in messages %}{{ m.role }}{% endfor %}", {"bos": "!"})))
    assert t.render(MESSAGES[:1])[0] == "!system"


@pytest.mark.parametrize(
    "source",
    [
        "{{ ''.__class__ }}", "{{ m.__class__ }}", "{{ loop.__init__ }}", "{{ messages }}", "{{ open('x') }}", "{{ 'a' * 9 }}", "{{ x | eval }}", "{{ 'a' + 1 }}", "{{ ('a' }}", "{{ }}", "{{ a b }}", "{{ 1 @ 2 }}", "{{ x['a' ~ y] }}",
        "{% if x %}", "{% for m in x %}{% endfor %}", "{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}", "{% if x %}{% for m in messages %}{% endfor %}{% endif %}",
        "{% endfor %}", "{% include 'x' %}", "{% set loop = 1 %}", "{% set bos = 1 %}", "{{ " + "(" * 50 + "1" + ")" * 50 + " }}", "{% if x %}" * 50 + "{% endif %}" * 50, "x" * 70_000, "{{ 'a' | trim('b') }}",
    ],
)
def test_what_a_template_may_not_say(source):
    with pytest.raises(TemplateError):
        Template(source, {"bos": "x"}).render(MESSAGES)


def test_missing_fields_and_whole_messages_are_errors():
    for source in ("{% for m in messages %}{{ m.tool }}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}", "{{ loop.index }}"):
        with pytest.raises(TemplateError):
            Template(source).render(MESSAGES)
