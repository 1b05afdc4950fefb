"""Option readers, budgets and conditions: plain Python, no tables."""

import random

import pytest

from trajecta.functions import options, requests


def test_configurations():
    a, b = options.configurations("one:q,o@30-32@12k; two: gate@0-0@8k ;")
    assert (a.label, a.targets, list(a.layers), a.windows) == ("one", ("q", "o"), [30, 31, 32], "12k") and b.modules == {"gate_proj": "mlp"}
    assert a.pattern == r"model\.language_model\.layers\.(30|31|32)\.(self_attn\.(q_proj|o_proj))"
    for bad in ("", ";", "a", "a:q@1-2", "a:q@1-2@9k", "a:zz@1-2@8k", "a:@1-2@8k", "a:q@3-2@8k", "a:q@x-2@8k", ":q@1-2@8k", "a:q@1-2@8k;a:o@1-2@8k"):
        with pytest.raises(ValueError):
            options.configurations(bad)


def test_settings(tmp_path):
    assert options.evaluation_settings(tmp_path / "none.yaml") == {}
    (tmp_path / "a.yaml").write_text("evaluation:\n  minutes: 8.5  # cap\n  tasks: 12\n  name: 'a: b'\n  deep:\n    on: true\n    off: null\nother: 1\n")
    assert options.evaluation_settings(tmp_path / "a.yaml") == {"minutes": 8.5, "tasks": 12, "name": "a: b", "deep": {"on": True, "off": None}}
    (tmp_path / "b.yaml").write_text("---\nminutes: 3\n")
    assert options.evaluation_settings(tmp_path / "b.yaml") == {"minutes": 3}
    with pytest.raises(ValueError):
        options.plain_yaml("- a\n")


def test_small_readers(tmp_path):
    assert options.memory_faults("4096, a@step,b,c@8192") == ({4096}, [("a", "step"), ("b", None), ("c", 8192)])
    assert options.model_ids("base", ["x", "base", "x", "y"]) == ["base", "x", "y"]
    (tmp_path / "t.jinja").write_text("x")
    asked = options.asset_candidates(None, {"T": str(tmp_path / "gone"), "HOME_": str(tmp_path)}, "T", "HOME_", "t.jinja", ["/nowhere"])
    assert options.first_file(asked) == tmp_path / "t.jinja" and options.first_file([None, "/nowhere"]) is None


def test_content_format():
    loop = lambda over: "{% for m in " + over + " %}{% for part in m['content'] %}{{ part }}{% endfor %}{% endfor %}"
    assert options.content_format(loop("messages")) == "openai" == options.content_format("{% set rest = messages[1:] %}{%- set r2 = rest | list -%}" + loop("r2"))
    assert options.content_format("{% for m in messages %}{{ m.content }}{% endfor %}") == "string" == options.content_format(loop("tools"))


def emitted(budget, proposals, start=(100,), end=(101,), prompt=None):
    """The rule, told over the whole history."""
    last = lambda seq, sub: max((i for i in range(len(seq) - len(sub) + 1) if list(seq[i : i + len(sub)]) == list(sub)), default=-1)
    out, forcing, inside, count = [], [], False, 0
    if prompt is not None and last(prompt, start) > last(prompt, end):
        inside, count = True, len(prompt) - last(prompt, start) - len(start)
        if count >= budget:
            inside, forcing = False, list(end)
    for t in proposals:
        if forcing:
            out.append(forcing.pop(0))
            continue
        out.append(t)
        if out[-len(start) :] == list(start):
            inside, count = True, 0
        elif out[-len(end) :] == list(end):
            inside, count = False, 0
        elif inside:
            count += 1
        if inside and count >= budget:
            inside, forcing = False, list(end)
    return out


@pytest.mark.parametrize("start, end", [((100,), (101,)), ((100, 7), (101, 8, 9))])
def test_budget_against_the_whole_history(start, end):
    rng = random.Random(len(end))
    alphabet = [1, 2, *start, *end]
    for _ in range(300):
        proposals, budget = rng.choices(alphabet, k=rng.randrange(25)), rng.randrange(5)
        prompt = rng.choices(alphabet, k=rng.randrange(8)) if rng.random() < 0.5 else None
        machine = requests.Budget(budget, start, end) if prompt is None else requests.Budget.after(prompt, budget, start, end)
        got = []
        for t in proposals:
            got.append(machine.step(t))
            machine = requests.Budget(budget, start, end, *machine.state)  # a state that has been stored goes on alike
        assert got == emitted(budget, proposals, start, end, prompt)


def test_conditions_refuse_what_they_do_not_know():
    assert requests.parse_condition("a=temp:0.5, top_k:3").overrides() == {"temperature": 0.5, "top_k": 3}
    assert requests.parse_condition("a=max_tokens:5,think:off").overrides() == {"max_completion_tokens": None, "max_tokens": 5, "enable_thinking": False}
    assert requests.parse_condition("a=").ops == () and requests.parse_condition("a=budget:64").overrides() == {"thinking_token_budget": 64}
    for bad in ("", "=temp:1", "a", "a=temp"):
        with pytest.raises(ValueError):
            requests.parse_condition(bad)
    with pytest.raises(ValueError):
        requests.parse_condition("a=warp:9").overrides()
