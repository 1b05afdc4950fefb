"""Option readers: what a command line or a settings file gives, as values; none of them touches a table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from .requests import module_pattern

#: Modules that an adapter may have, and their parents.
TARGETS = {"q": ("q_proj", "self_attn"), "o": ("o_proj", "self_attn"), "gate": ("gate_proj", "mlp"), "up": ("up_proj", "mlp"), "down": ("down_proj", "mlp")}


def plain_yaml(text: str) -> dict:
    """The mappings of a settings file: ``key: value`` lines nested by indentation, with numbers, words and quoted texts.

    Enough for settings; lists and anchors are left to a YAML library. Raises ValueError for other lines.
    """
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for n, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() == "---":
            continue
        m = re.fullmatch(r"( *)([^:\s][^:]*):(?:\s+(.*))?", bare)
        if not m:
            raise ValueError(f"line {n} is no setting: {line!r}")
        depth, key, value = len(m[1]), m[2].strip().strip("\"'"), m[3]
        while depth <= open_[-1][0]:
            open_.pop()
        if value is None:
            open_[-1][1][key] = inner = {}
            open_.append((depth, inner))
        else:
            open_[-1][1][key] = _yaml_value(value.strip())
    return root


def _yaml_value(text: str) -> object:
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def evaluation_settings(path: str | Path) -> dict:
    """The settings of a run: what stands under ``evaluation``, or all of them; none without a file."""
    path = Path(path)
    found = plain_yaml(path.read_text(encoding="utf-8")) if path.exists() else {}
    return found.get("evaluation", found) or {}


@dataclass(frozen=True)
class Configuration:
    label: str
    targets: tuple[str, ...]
    layers: range
    windows: str

    @property
    def modules(self) -> dict[str, str]:
        """The modules' names and parents."""
        return dict(TARGETS[t] for t in self.targets)

    @property
    def pattern(self) -> str:
        return module_pattern(self.layers, self.modules)


_CONFIGURATION = re.compile(r"\s*(?P<label>[^:;]*[^:;\s])\s*:(?P<targets>[^@;]*)@\s*(?P<lo>\d+)\s*-\s*(?P<hi>\d+)\s*@\s*(?P<windows>[^@;\s]+)\s*")


def configurations(spec: str, windows: Iterable[str] = ("12k", "8k")) -> list[Configuration]:
    """label:targets@lo-hi@windows;... in the order in which they are tried.

    Raises ValueError where an item has another form, an unknown module or window set, layers that fall, or a label that
    is there already, and for an empty list.
    """
    out: list[Configuration] = []
    for item in filter(str.strip, spec.split(";")):
        m = _CONFIGURATION.fullmatch(item)
        targets = tuple(filter(None, map(str.strip, m["targets"].split(",")))) if m else ()
        if not m or not targets or not set(targets) <= set(TARGETS) or m["windows"] not in set(windows) or int(m["lo"]) > int(m["hi"]) or any(c.label == m["label"] for c in out):
            raise ValueError(f"bad configuration {item.strip()!r}; expected label:targets@lo-hi@windows")
        out.append(Configuration(m["label"], targets, range(int(m["lo"]), int(m["hi"]) + 1), m["windows"]))
    if not out:
        raise ValueError("no configuration")
    return out


def memory_faults(spec: str) -> tuple[set[int], list[tuple[str, int | str | None]]]:
    """Faults to play: numbers are window lengths, label or label@at rules (at: a length, or step)."""
    items = [t for t in map(str.strip, spec.split(",")) if t]
    rules = [t.partition("@")[::2] for t in items if not t.isdigit()]
    return {int(t) for t in items if t.isdigit()}, [(label, int(at) if at.isdigit() else at or None) for label, at in rules]


def model_ids(served: str, adapters: Sequence[str]) -> list[str]:
    """The served model and its adapters, each once, the model first."""
    return list(dict.fromkeys([served, *adapters]))


def first_file(candidates: Iterable[str | Path | None]) -> Path | None:
    """The first candidate that is a file: given explicitly, by the environment, in the asset folder, or installed."""
    return next((p for p in (Path(c).expanduser() for c in candidates if c) if p.is_file()), None)


def asset_candidates(explicit: str | None, environment: Mapping[str, str], variable: str, home: str, name: str, installed: Sequence[str] = ()) -> list[str | None]:
    """Where an asset is looked for, in order of precedence."""
    folder = environment.get(home)
    return [explicit, environment.get(variable), f"{folder}/{name}" if folder else None, *installed]


_LOOP = re.compile(r"\{%-?\s*for\s+(\w+)\s+in\s+(.+?)\s*(?:if\b.*?)?-?%\}")
_SET = re.compile(r"\{%-?\s*set\s+(\w+)\s*=\s*(.+?)\s*-?%\}")


def content_format(template: str) -> str:
    """openai if a chat template goes through the parts of a message's content, else string.

    Names that a list of messages is set to (also sliced or filtered) count as such a list; a loop over one names a message.
    """
    base = lambda expr: re.sub(r"(\[[^\]]*:[^\]]*\]|\s*\|\s*\w+(\([^)]*\))?)+$", "", expr.strip()).strip("() ")
    lists = {"messages"}
    while more := {name for name, expr in _SET.findall(template) if base(expr) in lists} - lists:
        lists |= more
    loops = [(name, base(expr)) for name, expr in _LOOP.findall(template)]
    messages = {name for name, over in loops if over in lists}
    parts = {f"{m}{access}" for m in messages for access in (".content", "['content']", '["content"]')}
    return "openai" if any(over in parts for _, over in loops) else "string"
