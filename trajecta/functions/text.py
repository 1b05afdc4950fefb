"""Column builders over message texts, paths, shell commands and patches.

Java's regular expressions stand in for the ones the rules were written in: (?d) keeps "." to U+000A alone,
(?U) makes classes Unicode-wide. Trimming cuts Unicode white space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programs that run code, and programs that look at it.
RUN_PROGRAMS = ["python", "pytest", "py.test", "nosetests", "tox", "nox", "coverage", "trial", "unittest"]
INSPECT_PROGRAMS = ["grep", "egrep", "fgrep", "rg", "ag", "find", "ls", "cat", "head", "tail", "sed", "awk", "wc", "tree", "nl", "less", "more", "file", "stat", "git", "pwd", "which", "type", "du"]
SEARCH_PROGRAMS = ["grep", "egrep", "fgrep", "rg", "ag"]
TEST_PROGRAMS = ["pytest", "py.test", "nosetests", "tox", "nox"]
FILE_PROGRAMS = ["cd", "rm", "mv", "cp", "mkdir"]

#: Patterns of shell errors, forbidden actions, path classes and edits through the shell.
INVOCATION_ERROR = (
    r"command not found|No such file or directory|can't open file|cannot access|Permission denied|Is a directory|"
    r"unrecognized arguments|invalid option|unknown option|illegal option|usage:|Usage:|syntax error near|"
    r"ERROR: file or directory not found|ERROR: not found:|no tests ran|ERROR: usage"
)
FORBIDDEN = r"\bpip3?\s+install\b|\bpython3? -m pip install\b|\bconda install\b|\bcurl\b|\bwget\b"
TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$"
CONFIG_PATH = r"(^|/)(pyproject\.toml|setup\.cfg|setup\.py|tox\.ini|pytest\.ini|noxfile\.py|requirements[^/]*\.txt|MANIFEST\.in|\.pre-commit-config\.yaml)$"
SHELL_EDIT = r"\bsed\s+-i|\bperl\s+-[a-z]*i|\bgit\s+apply\b|\bpatch\s+-p"

#: How an error result shows in a tool message's text, plain and encoded once more.
ERROR_MARKS = ['"status": "error"', '\\"status\\": \\"error\\"']


def strip(c: Column) -> Column:
    """Cuts white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(f"(?d){pattern}"))


def holds_any(c: Column, texts: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | c.contains(t)
    return out


def content_text(content: Column, sep: str = " ") -> Column:
    """Content that is a text, or a JSON list of parts, as text; parts without a text count as empty. Nulls stay."""
    value = F.try_parse_json(content)
    listed = F.coalesce(F.schema_of_variant(value).rlike("^ARRAY<(OBJECT|VOID)"), F.lit(False))
    parts = F.from_json(content, "array<struct<text:string>>")
    return F.when(listed, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), sep)).otherwise(content)


def system_text(messages: Column, sep: str = " ") -> Column:
    """The content of a leading system or developer message, else empty. Messages: array of structs role, content.

    Parts are joined by ``sep``: a blank in statistics, nothing in replayed conditions.
    """
    first = F.try_element_at(messages, F.lit(1))
    return F.when(first["role"].isin("system", "developer"), F.coalesce(content_text(first["content"], sep), F.lit(""))).otherwise(F.lit(""))


def first_user(messages: Column, width: int = 200) -> Column:
    """The start of the first user content; a list of parts is taken as its JSON text."""
    user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]
    return F.left(F.coalesce(user, F.lit("")), F.lit(width))


def role_label(text: Column, rules: Sequence[tuple[str, str]] = ()) -> Column:
    """The name of the first rule whose pattern is found, else the first line's 40 characters, else a fixed label."""
    first = F.left(F.substring_index(text, "\n", 1), F.lit(40))
    out = F.when(first != "", first).otherwise(F.lit("(no system prompt)"))
    for name, pattern in reversed(list(rules)):
        out = F.when(matches(text, pattern), F.lit(name)).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _words(command: Column) -> Column:
    """The words of a command behind cd, assignments, export, env, time and timeout N."""
    body = F.regexp_replace(strip(command), r"(?U)^(?:cd\s+\S+\s*(?:&&|;)\s*)+", "")
    body = F.regexp_replace(strip(body), r"(?U)^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|export|env|time)(?:\s+|$))+", "")
    body = F.regexp_replace(body, r"(?U)^timeout(?:\s+\S+)?(?:\s+|$)", "")
    return F.filter(F.split(strip(body), r"(?U)\s+"), lambda w: w != "")


def main_program(command: Column) -> Column:
    """The first program of a shell command, python in any version being python; empty if there is none."""
    name = basename(F.coalesce(F.try_element_at(_words(command), F.lit(1)), F.lit("")))
    return F.when(F.regexp_like(name, F.lit(r"^python[0-9.]*$")), F.lit("python")).otherwise(name)


def arguments(command: Column) -> Column:
    words = _words(command)
    return F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ")).otherwise(F.lit(""))


def classify_command(command: Column) -> Column:
    """run, inspect, edit, scratch or other, by the first line."""
    first = F.substring_index(strip(command), "\n", 1)
    program, rest = main_program(first), arguments(first)
    run = program.isin(RUN_PROGRAMS) | (program.endswith(".sh") & program.contains("test")) | ((program == "make") & rest.contains("test"))
    return (
        F.when(F.regexp_like(first, F.lit(SHELL_EDIT)), F.when(first.contains("/tmp/"), "scratch").otherwise("edit"))
        .when(program.isin("cat", "tee", "echo", "printf") & F.regexp_like(rest, F.lit(r">\s*\S")), F.when(rest.contains("/tmp/"), "scratch").otherwise("edit"))
        .when(run, "run").when(program.isin(INSPECT_PROGRAMS), "inspect").otherwise("other")
    )


def is_test_command(command: Column) -> Column:
    program = main_program(command)
    return program.isin(TEST_PROGRAMS) | command.contains("-m pytest") | command.contains("-m unittest") | ((program == "make") & arguments(command).contains("test"))


def tool_error(name: Column, command: Column, status: Column, exit_code: Column, message: Column, stderr: Column) -> Column:
    """Whether a result is an error that a wrong call caused; failing tests and reproductions are none. Nulls count as absent."""
    text = F.concat(F.coalesce(message, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    command = F.coalesce(command, F.lit(""))
    program = main_program(command)
    code = exit_code.cast("int")
    found_nothing = code.eqNullSafe(1) & program.isin(SEARCH_PROGRAMS) & (strip(text) == "")
    odd_code = code.isNull() | ~code.isin(0, 1)
    shell = (
        F.when(F.coalesce(code.isin(126, 127), F.lit(False)), F.lit(True))
        .when(is_test_command(command), F.coalesce(code.isin(4, 5), F.lit(False)))
        .when(program == "python", F.regexp_like(F.left(text, F.lit(400)), F.lit("can't open file|No such file or directory: '/")) & ~text.contains("Traceback"))
        .when(program.isin(INSPECT_PROGRAMS + FILE_PROGRAMS), ~found_nothing & (F.regexp_like(text, F.lit(INVOCATION_ERROR)) | odd_code))
        .otherwise(F.regexp_like(F.left(text, F.lit(2000)), F.lit(INVOCATION_ERROR)))
    )
    return F.coalesce(status == "error", F.lit(False)) & ((name != "run_command") | shell)


def edit_outcome(content: Column) -> Column:
    """ok, not_found or error, by a tool message's text."""
    return F.when(holds_any(content, ERROR_MARKS), F.when(F.lower(content).contains("not found"), "not_found").otherwise("error")).otherwise("ok")


def result_encoding(content: Column) -> Column:
    """raw (no JSON), double (an object with a JSON object or array in the string result) or single."""
    value = F.try_parse_json(content)
    inner = F.try_variant_get(value, "$.result", "string")
    only = F.json_object_keys(content).eqNullSafe(F.array(F.lit("result"))) & F.schema_of_variant(F.try_variant_get(value, "$.result", "variant")).eqNullSafe("STRING")
    nested = F.coalesce(F.schema_of_variant(F.try_parse_json(inner)).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(value.isNull(), "raw").when(F.coalesce(only, F.lit(False)) & nested, "double").otherwise("single")


def variant_encoding(content: Column) -> Column:
    """The encoding of a result that may be any JSON value (a variant): a text's own, parts for a list, else other."""
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", result_encoding(F.try_variant_get(content, "$", "string"))).when(kind.startswith("ARRAY"), "parts").otherwise("other")


def patch_files(patch: Column) -> Column:
    """The files of a unified diff: array of structs path, new, deleted, add, rem; lines before the first header count for none.

    The diff is cut at its headers, so each file is folded from its own lines.
    """
    sections = F.filter(F.split(F.concat(F.lit("\n"), patch), r"\n(?=diff --git )", -1), lambda s: s.startswith("diff --git "))

    def file(s: Column) -> Column:
        lines = F.split(s, "\n", -1)
        head = F.try_element_at(lines, F.lit(1))
        named = F.regexp_extract(head, r"^diff --git a/(\S+) b/(\S+)", 2)
        count = lambda sign, triple: F.size(F.filter(lines, lambda l: l.startswith(sign) & ~l.startswith(triple))).cast("long")
        return F.struct(
            F.when(named != "", named).otherwise(F.substring(F.try_element_at(F.filter(F.split(head, r"\s+"), lambda w: w != ""), F.lit(-1)), 3, 1 << 30)).alias("path"),
            F.exists(lines, lambda l: l.startswith("new file mode")).alias("new"),
            F.exists(lines, lambda l: l.startswith("deleted file mode")).alias("deleted"),
            count("+", "+++").alias("add"), count("-", "---").alias("rem"),
        )

    return F.transform(sections, file)


def patch_stats(patch: Column) -> Column:
    """files, changed, src_changed, src_files and four flags of a diff; null for a null patch."""
    files = patch_files(patch)
    path = lambda f: f["path"]
    test = lambda f: F.regexp_like(path(f), F.lit(TEST_PATH))
    junk = lambda f: ~test(f) & ((f["new"] & ~path(f).contains("/")) | path(f).contains(".egg-info/") | path(f).contains("/EGG-INFO/"))
    source = lambda f: ~test(f) & ~junk(f) & path(f).endswith(".py")
    total = lambda fs: F.aggregate(fs, F.lit(0).cast("long"), lambda a, f: a + f["add"] + f["rem"])
    return F.when(patch.isNotNull(), F.struct(
        F.size(files).cast("long").alias("files"), total(files).alias("changed"), total(F.filter(files, source)).alias("src_changed"),
        F.size(F.filter(files, source)).cast("long").alias("src_files"),
        F.exists(files, lambda f: test(f) & ~f["new"]).alias("edits_existing_test"), F.exists(files, lambda f: test(f) & f["new"]).alias("adds_test"),
        F.exists(files, junk).alias("adds_root_file"), F.exists(files, lambda f: F.regexp_like(path(f), F.lit(CONFIG_PATH))).alias("touches_config"),
    ))


def patch_score(stats: Column) -> Column:
    """The patch signal of a trajectory: small, in few files, without touched tests, left-over files or configuration; 0 without a patch."""
    changed, n = stats["src_changed"].cast("double"), stats["src_files"]
    size = F.when(changed <= 15, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.log2(changed / 15.0) / 4.0))
    files = F.when(n <= 2, 1.0).when(n == 3, 0.85).when(n == 4, 0.7).otherwise(0.5)
    factor = lambda flag, f: F.when(stats[flag], F.lit(f)).otherwise(F.lit(1.0))
    return F.when(stats.isNull(), F.lit(0.0)).otherwise(size * files * factor("edits_existing_test", 0.3) * factor("adds_root_file", 0.6) * factor("adds_test", 0.8) * factor("touches_config", 0.8))


def line_subset(earlier: Column, later: Column) -> Column:
    """Whether every non-blank line of the earlier text is in the later one, and there is one."""
    lines = lambda c: F.filter(F.split(c, "\n", -1), lambda l: strip(l) != "")
    return (F.size(lines(earlier)) > 0) & (F.size(F.array_except(lines(earlier), lines(later))) == 0)


def distinct_lines(text: Column) -> Column:
    """The lines of a text, each at its first place only."""
    return F.array_join(F.array_distinct(F.split(text, "\n", -1)), "\n")


def tree_listing(listing: Column, root: str = "/workspace/", most: int = 149) -> Column:
    """A sorted listing below a root, hidden paths left out, under a line with a dot; empty for another listing."""
    rows = F.filter(F.split(listing, "\n", -1), lambda l: l.startswith(root) & (l != root) & ~l.contains("/."))
    named = F.transform(rows, lambda l: F.concat(F.lit("./"), F.regexp_replace(F.substring(l, len(root) + 1, 1 << 30), "/+$", "")))
    return F.when(listing.startswith(root), F.array_join(F.concat(F.array(F.lit(".")), F.slice(F.array_sort(F.array_distinct(named)), 1, most)), "\n")).otherwise(F.lit(""))


def whitespace_tokens(text: Column) -> Column:
    """The number of words, as the default count of tokens."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def memory_gib(message: Column) -> Column:
    """The memory figure of an out-of-memory message in GiB, rounded to 3 digits; null where there is none."""
    first, second = r"HLO temporaries \(([\d.]+)([KMGT])", r"[Uu]sed ([\d.]+)([KMGT]) of"
    part = lambda n: F.when(F.regexp_like(message, F.lit(first)), F.regexp_extract(message, first, n)).otherwise(F.regexp_extract(message, second, n))
    scale = F.when(part(2) == "K", 2.0**-20).when(part(2) == "M", 2.0**-10).when(part(2) == "G", 1.0).when(part(2) == "T", 1024.0)
    return F.round(part(1).try_cast("double") * scale, 3)


def layer_numbers(spec: Column) -> Column:
    """0,5,30-59 as a sorted array of distinct numbers."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    spans = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.coalesce(F.get(F.split(p, "-"), F.lit(1)), F.split(p, "-")[0]).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))
