"""Name-value pairs with a type between name and value, and values with a leading slash."""

import random
import time

import pytest

from millrace.llm import secrets

VALUE = "wJalrXUtnFEMI7K8bPxRfi"


@pytest.mark.parametrize(
    "line",
    [
        f'secret_access_key: str = "{VALUE}"',
        f'const dbPass: string = "{VALUE}"',
        f"private readonly dbPass?: string | undefined = '{VALUE}'",
        f'db_pass: Optional[str] = "{VALUE}"',
        f'db_pass: dict[str, list[str]] = "{VALUE}"',
        f"let dbPass: Array<string>=`{VALUE}`",
        f'static SIGNING_KEY: &\'static str = "{VALUE}"',
        f'def f(user: str, db_pass: str = "{VALUE}"):',
        f'var signingKey string = "{VALUE}"',
        f'\tsigningKey []byte = "{VALUE}"',
        f'env: db_pass = "{VALUE}"',
        f'x: str = "{VALUE}"\ndb_pass = x',
        f"signing_key=/{VALUE}",
        f"signing_key:/{VALUE}",
    ],
)
def test_value_is_found(line):
    got = [line[a:b] for k, a, b in secrets.spans(line) if k == "literal"]
    assert [x.lstrip("/") for x in got] == [VALUE]
    assert VALUE not in secrets.redacted(line, secrets.spans(line), "[SECRET]")


@pytest.mark.parametrize("line", [f'const label: string = "{VALUE}"', f'user string = "{VALUE}"', f"signing_key://{VALUE}", f'if db_pass == "{VALUE}"', "db_pass: str", "db_pass: string == x"])
def test_others_are_not(line):
    assert secrets.literal_spans(line) == []


def test_declared_names_stay_names():
    """A keyword or type before the name is no name of its own."""
    for line in (f'String dbPass = "{VALUE}"', f'const dbPass = "{VALUE}"', f'var dbPass = "{VALUE}"', f'"dbPass": "{VALUE}"'):
        assert [line[a:b] for _, a, b in secrets.literal_spans(line)] == [VALUE]


def test_time_is_linear_in_the_text():
    for part in ("a: b[", "a: b<c[", "a: b | ", "a ", "a:b|a:b[c]", "a [] "):
        took = []
        for n in (5_000, 40_000):
            began = time.perf_counter()
            secrets.spans(part * n + "=")
            took.append(time.perf_counter() - began)
        assert took[1] < 0.2 + 30 * took[0], part


def test_rows_of_typed_names_take_linear_time():
    """Eight times the text takes about eight times as long, whatever stands between the names."""
    rng = random.Random(1)
    parts = ["a", "b1", ":", "|", "&", "<", ">", "[", "]", " ", "=", "?", "::", ".", '"', "'", "*", "(", ")", ",", "x_key"]
    mixes = ["a:x |", "a: b | ", "a:x &", "a:b|a:b[c]", "a:x::y |", *["".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) for _ in range(20)]]
    for mix in mixes:
        took = []
        for n in (8_000, 64_000):
            text = (mix * n)[:n]
            took.append(min(timed(text) for _ in range(2)))
        assert took[1] < 10.5 * max(took[0], 0.004), (mix, took)
    assert timed(("a:x |" * 250_000)[: 1 << 20]) < 4


def timed(text):
    began = time.process_time()
    secrets.spans(text)
    return time.process_time() - began


def test_types_with_several_alternatives():
    text = "db_password: string | undefined | std::String<u8> = 'xK9vQ2mLp4'\n"
    assert [text[a:b] for k, a, b in secrets.spans(text) if k == "literal"] == ["xK9vQ2mLp4"]
    text = "a: str | db_password: str | None = 'xK9vQ2mLp4'\n"
    assert [text[a:b] for k, a, b in secrets.spans(text) if k == "literal"] == ["xK9vQ2mLp4"]
