"""Replies of a vision model, whole and broken off."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import reply as R

FULL = {"markdown": "# Page\n\nU1 drives \"`I2C1_SDA`\" \\ `VCC_IO` é 😀 end", "major_components": ["U1", " U2 ", "U1"], "nets": ["A_B", "C"], "interfaces": ["I2C"], "extra": {"deep": [1, {"x": None}], "more": "t"}}


def test_whole_replies():
    want = {"markdown": FULL["markdown"], "major_components": ["U1", "U2"], "nets": ["A_B", "C"], "interfaces": ["I2C"]}
    text = json.dumps(FULL)
    for said in (text, f"```json\n{text}\n```", f"Here it is:\n```\n{text}\n```\nbye", json.dumps(FULL, ensure_ascii=False, indent=2)):
        assert R.parsed(said) == want


@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_beginning_gives_a_beginning_of_the_fields(ascii_only):
    text = json.dumps(FULL, ensure_ascii=ascii_only, indent=1)
    for n in range(1, len(text) + 1):
        made, whole = R.payload(text[:n])
        assert whole == (n == len(text))
        for name, value in made.items():
            if isinstance(value, list) and name in R.LISTS:
                assert value == FULL[name][: len(value)]
        assert FULL["markdown"].startswith(made.get("markdown", ""))
        got = R.parsed(text[:n])
        assert FULL["markdown"].startswith(got["markdown"])
    assert made == json.loads(text)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.sampled_from([1.5, -2e9]) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=5), JSON, max_size=4), st.booleans(), st.data())
def test_parser_equals_the_library_and_holds_on_beginnings(value, ascii_only, data):
    text = json.dumps(value, ensure_ascii=ascii_only)
    made, whole = R.payload(text)
    assert whole and made == value
    part, whole = R.payload(text[: data.draw(st.integers(1, len(text)))])
    assert begins(part, value)


def begins(part, value):
    if isinstance(part, str):
        return isinstance(value, str) and value.startswith(part)
    if isinstance(part, list):
        return isinstance(value, list) and part == value[: len(part)]
    if isinstance(part, dict):
        return isinstance(value, dict) and all(k in value and begins(v, value[k]) for k, v in part.items())
    return part == value


def test_plain_markdown():
    got = R.parsed("```markdown\n# T\nU3 and `SPI_CLK`, `MCU`, r7\n```")
    assert got == {"markdown": "# T\nU3 and `SPI_CLK`, `MCU`, r7", "major_components": ["U3", "r7"], "nets": ["SPI_CLK"], "interfaces": ["SPI_CLK"]}
    got = R.parsed("# T\nbody U9\n<!-- any:major_components=U1, U2;nets=N_1;interfaces= -->")
    assert got == {"markdown": "# T\nbody U9", "major_components": ["U1", "U2"], "nets": ["N_1"], "interfaces": []}
    assert R.parsed("# T\n本页核心主题\nkept\n{\"markdown\": 1")["markdown"] == "# T\nkept"
    assert R.parsed("") == R.parsed(None) == {"markdown": "", "major_components": [], "nets": [], "interfaces": []}


def test_loops_are_cut():
    loop = "the same line again and more "
    assert R.parsed("Start of it. " + loop * 30)["markdown"].count("the same line") <= 2
    assert R.without_loop("short " * 3) == "short " * 3 and R.without_loop("abc" * 100)
    assert R.parsed("x" * 100_000)["markdown"] == "x" * 24


def test_lists_break_off_and_wrong_kinds():
    assert R.parsed('{"markdown": "m", "nets": ["A", "B')["nets"] == ["A"]
    assert R.parsed('{"markdown": "m", "nets": "A", "major_components": [1, null, "U1"]}')["major_components"] == ["1", "None", "U1"]
    assert R.parsed('{"markdown": "line\nbreak", "nets": []')["markdown"] == "line\nbreak"
    assert R.parsed('{"mark')["markdown"] == ""


def test_column(spark):
    rows = spark.createDataFrame([(1, json.dumps(FULL)), (2, None), (3, "plain")], "i long, reply string")
    got = {r.i: r.parsed for r in R.with_parsed(rows, "reply").collect()}
    assert got[1].nets == ["A_B", "C"] and got[2].markdown == "" and got[3].markdown == "plain"
