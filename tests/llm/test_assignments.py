"""The lexer of assignments, form by form, and base spans against a scan of their own."""

import random
import time

import pytest

from tabulon.llm.secret_scan import base_spans, lexed_literals, name_weight

A, B = "S3cr3tVal9xQ", "Zz9S3cr3tVal"
FORMS = [
    f"config['password'] = '{A}'", f'os.environ["API_KEY"] = "{A}"', f"cfg['db'][\"password\"] = '{A}'", f"<password>{A}</password>",
    f'<password type="x">\n  {A}\n</password>', f'#define API_SECRET "{A}"', f"#  define API_SECRET {A}", f"password:\n  {A}\nname: bob",
    f"db:\n  password: |\n    {A}\n  user: bobsomething9", '{"auth_token": {"value": "%s"}, "name": {"value": "Bob9something"}}' % A,
    f"export DB_PASSWORD={A}", f'password = """{A}"""', f"password = '''{A}'''", f'k = "{A}"\npassword = f"{{k}}"', f'k = "{A}"\nauth_token = wrap(k)',
    f'k = "{A}"\nauth_token = wrap(other, deep(k))', f'connect(user="bob9xkdlq", password="{A}", port=5)', f'token: str = "{A}"', f'password := "{A}"',
    f"'password' => '{A}',", f'a = "Nope{B}"; password = "{A}"', f'password = (\n  "{A}"\n)', f"let apiKey = `{A}`;", f'password = b"{A}"',
    f'k = "{A}"\nj = k\nk = "Other{B}"\npassword = j', f"password={A}", f'password =\n    "{A}"', f'k = "{A}"\npassword = ${{k}}',
]
PAIRS = [
    f"tokens = ['{A}', '{B}']", f'password = (\n "{A}"\n  "{B}"\n)', f'password = "{A}" \\\n   "{B}"', f'password = "{A}" +\n   "{B}"',
    f'password = "{A}"\n   + "{B}"\nother = "Nope{A}"', f"tokens:\n  - {A}\n  - {B}\nother:\n  - abcdef123", f"creds = [{{'password': '{A}'}}, {{'password': '{B}'}}]",
    f'a = "{A}"\nb = "{B}"\npassword = a + b', f'a = "{A}"\npassword = a .. "{B}"', f'password = ["{A}",\n  ("{B}")]',
]
HARMLESS = [
    "password: changeme", "see: http://x.y/z", "token = ${VAULT_TOKEN}", "token = {{ vault_token }}", "a == b", "title: A fine story", f"label = '{A}'", "password =\n\nS3cr3tVal9xQ",
    f"if password == '{A}':", "It's the user's token: a thing that doesn't matter; see 'other' note", f'k = "{A}"\nk = "x"\npassword = k', f"password = os.getenv('{A}') and x" if False else "password =",
]


@pytest.mark.parametrize("text", FORMS)
def test_forms(text):
    assert [text[a:b] for a, b, _ in lexed_literals(text)] == [A]


@pytest.mark.parametrize("text", PAIRS)
def test_forms_of_two(text):
    assert [text[a:b] for a, b, _ in lexed_literals(text)] == [A, B]


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert lexed_literals(text) == []


def test_no_literal_of_a_chain_is_lost():
    """A name given twenty joined literals, or a chain of two thousand names, and then a sensitive one."""
    parts = [f"Part{i}x{A}" for i in range(20)]
    text = "k = " + " + ".join(f'"{p}"' for p in parts) + "\npassword = k"
    assert [text[a:b] for a, b, _ in lexed_literals(text)] == parts
    lines = ['k0 = "%s0"' % A] + [f'k{i} = k{i - 1} + "{A}{i}"' for i in range(1, 2000)]
    assert len(lexed_literals("\n".join(lines) + "\npassword = k1999")) == 2000


def test_generated_assignments():
    """Random configurations, written down as one of several kinds of file: exactly the sensitive ones are found."""
    rng = random.Random(4)
    sign = {"py": "{} = '{}'\n", "json": '"{}": "{}",\n', "yaml": "{}: {}\n", "go": '{} := "{}"\n', "xml": "<{0}>{1}</{0}>\n", "php": "$x['{}'] = '{}';\n", "c": '#define {} "{}"\n'}
    for _ in range(300):
        names = rng.choices(["password", "db_password", "apiKey", "clientSecret", "color", "title", "user_name", "auth_token", "height"], k=6)
        values = ["".join(rng.choices("abcdefghXYZ0123456789", k=16)) + "aB3" for _ in names]
        form = rng.choice(list(sign.values()))
        text = "".join(form.format(n, v) for n, v in zip(names, values))
        assert [text[a:b] for a, b, _ in lexed_literals(text)] == [v for n, v in zip(names, values) if name_weight(n) > 0.5], text


@pytest.mark.parametrize("part", ['password = "', "password=$(", "{{", "password: \n", "a['", "password = [", '\\"', "x = (", "<password>", "k = k + k\n", "password +\n", "'''", "#define "])
def test_long_texts_take_linear_time(part):
    start = time.perf_counter()
    lexed_literals("password = 1\n" + part * (400_000 // len(part)))
    assert time.perf_counter() - start < 15


def scan(text):
    """Base spans letter by letter."""
    out = []
    keys = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    low = "".join(c.lower() if c.isascii() else "\0" for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        key = next((k for k in keys if low.startswith(k, at)), None)
        p = at + len(key) if key else at
        if key:
            q = p + (text[p : p + 1] in ('"', "'") and p < len(text))
            while text[q : q + 1] == " ":
                q += 1
            if text[q : q + 1] and text[q] in ":=":
                q += 1
                while text[q : q + 1] == " ":
                    q += 1
                q += bool(text[q : q + 1]) and text[q] in "\"'"
                end = q
                while end < len(text) and text[end] in value:
                    end += 1
                if end > q:
                    if end - q >= 6:
                        out.append((at, end, "assign"))
                    at = end
                    continue
        at += 1
    for kind, first, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            if text.startswith(first, at):
                end = at + len(first)
                while end < len(text) and text[end] in allowed:
                    end += 1
                if end - at >= least:
                    out.append((at, end, kind))
                if end > at + len(first):
                    at = end
                    continue
            at += 1
    return out


def test_base_spans_against_a_scan(texts):
    rng = random.Random(1)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_", "key", '"', "'", " ", "  ", ":", "=", "abcdef", "x", "AKIA", "B" * 16, "9", "0a" * 12, "f", "\n", "é", "K", "ſ", "=="]
    for text in [t or "" for t in texts] + ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(3000)]:
        assert sorted(base_spans(text)) == sorted(scan(text)), text
