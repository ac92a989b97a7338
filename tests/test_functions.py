"""Measurements and transforms of snippets: fixed values and properties."""

import math

import pytest

from twinloom.functions import codestyle, lexical, transforms

SAMPLE = {
    "c": '#include <stdio.h>  \n/* head */\nint add(int a, int b) {\n    int total = a + b; // sum\n\n\n    if (total > 3 && a) {\n        return total;\n    }\n    char *s = "// no";   \n    return 0;\n}\n',
    "cpp": 'int twice(int n)\n{\n  for (int i = 0; i < n; i++) {\n    n += i;\n  }\n  const char *r = R"x(/* kept */)x";\n  return n;\n}\n',
    "java": "class A {\n  public static int half(int n) {\n    try { n /= 2; } catch (Exception e) { throw e; }\n    return n; /* end */\n  }\n}\n",
    "py": '#!/usr/bin/env python\n# -*- coding: utf-8 -*-\ndef total(items, start=0):\n    out = start  # running\n    for x in items:\n        out += x\n\n\n    return f"{out}#"\n',
}


def named(code, language):
    return dict(zip(lexical.NAMES, lexical.analyze(code, language).values, strict=True))


@pytest.mark.parametrize(("name", "style"), [("abc", "camelCase"), ("aBc", "camelCase"), ("a_b", "snake_case"), ("Abc", "PascalCase"), ("A_B", "UPPER_SNAKE_CASE"), ("MAX", "Other"), ("X", "Other"), ("a1", "Other"), ("", "Other")])
def test_naming_style(name, style):
    assert codestyle.naming_style(name) == style


def test_empty_snippet():
    a = lexical.analyze("", "py")
    assert a.values == [0.0] * 18 and a.parse_ok and a.backend == "python-ast"
    assert codestyle.style_vector("", "py") == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert codestyle.style_vector(None, "py") is None


def test_small_function():
    v = named('def f(x):\n    if x: return "a"\n    return x\n\n', "py")
    assert v["identifier_entropy"] == pytest.approx(-(1 / 4) * math.log2(1 / 4) - (3 / 4) * math.log2(3 / 4))
    assert (v["identifier_length_mean"], v["identifier_length_std"]) == (1, 0)
    assert (v["branch_density"], v["function_count"], v["cyclomatic_complexity"], v["return_density"]) == (1 / 4, 1, 2, 1 / 2)
    assert v["ast_depth"] == 4


@pytest.mark.parametrize("tail", ["", "\nx = ("])
def test_literal_words(tail):
    v = named("a = True; b = False; c = None; d = ..." + tail, "py")
    assert v["keyword_density"] == 0
    if not tail:
        assert v["operator_density"] == v["literal_density"] == 4 / 12


def test_conditional_chain_and_layout():
    assert named("x = a if b else c if d else e", "py")["branch_density"] == pytest.approx(2 / 3)
    v = named("x\n\n    yy\n", "py")
    assert (v["blank_line_ratio"], v["line_length_mean"], v["line_length_std"], v["indentation_entropy"]) == (pytest.approx(1 / 3), 3.5, 2.5, 1)
    assert named("x = int(1", "py")["identifier_length_mean"] == 2


@pytest.mark.parametrize(("code", "language", "value"), [("# only\n", "py", 0), ("  \n", "c", 0), ("// x", "java", 0), ('"doc"', "py", 1), (";", "c", 1)])
def test_complexity_of_little(code, language, value):
    assert named(code, language)["cyclomatic_complexity"] == value


def test_formatted_string_is_one_literal():
    assert lexical.lexemes('y = f"{x!r} {1}"', "py").kinds == ["identifier", "operator", "literal"]


def test_bad_arguments():
    with pytest.raises(TypeError):
        lexical.analyze(None, "py")
    with pytest.raises(ValueError, match="unsupported"):
        lexical.analyze("x", "rust")


@pytest.mark.parametrize("language", SAMPLE)
def test_malformed_snippets_give_finite_values(language):
    for code in (SAMPLE[language][: len(SAMPLE[language]) // 2], '"' + SAMPLE[language], "\x00(" * 50, "é" * 1000, "((((" * 3000):
        assert all(map(math.isfinite, lexical.analyze(code, language).values))
        assert all(map(math.isfinite, codestyle.style_vector(code, language)))


@pytest.mark.parametrize("attack", transforms.ATTACKS)
@pytest.mark.parametrize("language", SAMPLE)
def test_transforms_are_deterministic_and_keep_parsing(language, attack):
    a, b = (transforms.apply(SAMPLE[language], language, attack) for _ in range(2))
    assert a == b and a.failure_reason is None and a.changed == (a.code != SAMPLE[language]) and a.changed == (a.transform_count > 0)
    again = transforms.transform(a.code, language, attack)[1]
    assert attack == "comment_injection" or again == 0 or attack in ("identifier_rename", "combined")


def test_comment_removal_keeps_strings_and_lines():
    for language, code in SAMPLE.items():
        out, _ = transforms.comment_removal(code, language)
        assert out.count("\n") == code.count("\n") and len(out) == len(code)
    assert '"// no"' in transforms.comment_removal(SAMPLE["c"], "c")[0]
    assert "/* kept */" in transforms.comment_removal(SAMPLE["cpp"], "cpp")[0]
    assert '#"' in transforms.comment_removal(SAMPLE["py"], "py")[0]


def test_rename_touches_locals_only():
    out, n = transforms.identifier_rename(SAMPLE["py"], "py")
    assert "def total(_t4_local_0, _t4_local_1=0)" in out and n > 5
    assert transforms.identifier_rename("def f(:", "py") == ("def f(:", 0)
    c, _ = transforms.identifier_rename(SAMPLE["c"], "c")
    assert "int add(int _t4_local_0, int _t4_local_1)" in c and "#include <stdio.h>" in c


def test_layout_leaves_protected_lines():
    code = 'x = """a  \n\n\n b"""  \n\n\ny = 1\t\n\n'
    assert transforms.format_normalization(code, "py")[0] == 'x = """a  \n\n\n b"""  \n\ny = 1\n'
    assert transforms.format_normalization("#define A \\\n  1  \nint x;  \n", "c")[0] == "#define A \\\n  1  \nint x;\n"


def test_injection_goes_after_cookie():
    lines = transforms.comment_injection(SAMPLE["py"], "py")[0].split("\n")
    assert lines[2] == transforms.INJECTED["py"]
    assert transforms.comment_injection("x", "c")[0] == transforms.INJECTED["c"] + "\nx"
    assert transforms.comment_injection("#!x", "py")[0] == "#!x\n" + transforms.INJECTED["py"] + "\n"


def test_parse_regression_is_flagged(monkeypatch):
    monkeypatch.setitem(transforms._ONE, "comment_removal", lambda code, language: ("def (", 1))
    assert transforms.apply("x = 1", "py", "comment_removal").failure_reason == "parse-regression"
    assert transforms.apply("def (", "py", "comment_removal").failure_reason is None
