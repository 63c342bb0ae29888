"""Instructions of content streams, with SQL functions where they suffice.

``instructions``: ``doc_id, page_index, seq, operator, operands`` (strings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed(instructions: DataFrame, operators: str) -> DataFrame:
    """Instructions of the listed operators (separated by spaces; none listed: all).

    As q and Q only make sense together, either of them lets all operators beginning
    with q or Q through; inline images need BI, ID and EI all three.
    """
    names = operators.split()
    if not names:
        return instructions
    keep = F.col("operator").isin(*names)
    if {"q", "Q"} & set(names):
        keep |= F.col("operator").rlike("^[qQ]")
    if {"BI", "ID", "EI"} <= set(names):
        keep |= F.col("operator") == "INLINE IMAGE"
    return instructions.where(keep)


def unparse(instructions: DataFrame, key: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """The content of each page: a line for each instruction, operands before the operator.

    A page's content is one value, so its instructions meet in one group; pages are many.
    """
    line = F.concat_ws(" ", F.array_join("operands", " "), F.col("operator"))
    line = F.when(F.size("operands") > 0, line).otherwise(F.col("operator"))
    parts = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return instructions.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p.line), "\n").alias("content"))


def ctm(instructions: DataFrame, key: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """For each Do, the transformation matrix it happens under; those under an invalid one are left out.

    ``instructions`` has ``operands`` as doubles and ``name`` (of a Do). A fold over the
    page's instructions keeps a stack: q pushes, Q pops (below the first: the identity),
    cm multiplies its matrix from the left of the current one; a cm without six operands
    makes the level invalid until it is popped.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "operator", "operands", "name")))
    m, c = "m.operands", "s.stack[0]"
    product = ", ".join(f"{m}[{i}] * {c}[{j}] + {m}[{i + 1}] * {c}[{j + 2}]{' + ' + c + f'[{j + 4}]' if i == 4 else ''}" for i in (0, 2, 4) for j in (0, 1))
    identity = "array(1D, 0D, 0D, 1D, 0D, 0D)"
    nothing = "cast(null as array<double>)"
    fold = f"""aggregate(steps, named_struct('stack', array({identity}), 'out', cast(array() as array<struct<seq:int,name:string,ctm:array<double>>>)), (s, m) -> case
      when m.operator = 'q' then named_struct('stack', concat(array(s.stack[0]), s.stack), 'out', s.out)
      when m.operator = 'Q' then named_struct('stack', if(size(s.stack) > 1, slice(s.stack, 2, size(s.stack) - 1), array({identity})), 'out', s.out)
      when m.operator = 'cm' then named_struct('stack', concat(array(if(size(m.operands) = 6 and s.stack[0] is not null, array({product}), {nothing})), slice(s.stack, 2, size(s.stack) - 1)), 'out', s.out)
      when m.operator = 'Do' and s.stack[0] is not null then named_struct('stack', s.stack, 'out', concat(s.out, array(named_struct('seq', cast(m.seq as int), 'name', m.name, 'ctm', s.stack[0]))))
      else s end, s -> s.out)"""
    done = instructions.groupBy(*key).agg(steps.alias("steps")).select(*key, F.expr(fold).alias("out"))
    return done.select(*key, F.explode("out").alias("o")).select(*key, "o.seq", "o.name", "o.ctm")


def text_width(texts: DataFrame, widths: DataFrame, size: float, missing: int, text: str = "text") -> DataFrame:
    """``texts`` with ``width``: the sum of the characters' widths (in thousandths), times the font size.

    ``widths``: ``code, width``, a font's table of at most 256 rows, which goes along as
    one array literal, so a text is one row throughout.
    """
    table = {r["code"]: r["width"] for r in widths.where("code between 0 and 255").select("code", "width").collect()}  # 256 rows at most
    array = "array(" + ", ".join(str(int(table.get(i, missing))) for i in range(256)) + ")"
    total = f"aggregate(split({text}, ''), 0L, (a, c) -> a + if(c = '', 0, coalesce(get({array}, ascii(c)), {int(missing)})))"
    return texts.withColumn("width", F.expr(total) * size / 1000)


def word_wrap(text: str, limit: int) -> str:
    """SQL: the lines of a text, words put together greedily up to ``limit`` characters.

    The fold only notes at which word each line starts; the lines are put together once.
    """
    on = f"s.i > 0 and s.col + 1 + length(x) <= {limit}"
    fold = f"aggregate(w, named_struct('col', 0, 'i', 0, 'starts', cast(array() as array<int>)), (s, x) -> if({on}, named_struct('col', s.col + 1 + length(x), 'i', s.i + 1, 'starts', s.starts), named_struct('col', length(x), 'i', s.i + 1, 'starts', concat(s.starts, array(s.i)))), s -> s.starts)"
    lines = "transform(b, (from, k) -> array_join(slice(w, from + 1, coalesce(get(b, k + 1), size(w)) - from), ' '))"
    return f"transform(array(split({text}, ' +')), w -> transform(array({fold}), b -> {lines})[0])[0]"


def word_wrap_widths(text: str, limit: float, widths: dict[int, int], size: float, missing: int = 0) -> str:
    """SQL: the lines of a text, words put together greedily as long as a line in a font of ``size`` is no wider than ``limit``.

    ``widths``: those of character codes below 256, in thousandths.
    """
    table = "array(" + ", ".join(str(int(widths.get(i, missing))) for i in range(256)) + ")"
    wide = f"aggregate(if(x = '', cast(array() as array<string>), split(x, '')), 0L, (a, c) -> a + coalesce(get({table}, ascii(c)), {int(missing)}))"
    space, most = int(widths.get(32, missing)), limit * 1000 / size
    step = f"transform(array({wide}), n -> if(s.i > 0 and s.col + {space} + n <= {most}, named_struct('col', s.col + {space} + n, 'i', s.i + 1, 'starts', s.starts), named_struct('col', n, 'i', s.i + 1, 'starts', concat(s.starts, array(s.i)))))[0]"
    fold = f"aggregate(w, named_struct('col', 0L, 'i', 0, 'starts', cast(array() as array<int>)), (s, x) -> {step}, s -> s.starts)"
    lines = "transform(b, (from, k) -> array_join(slice(w, from + 1, coalesce(get(b, k + 1), size(w)) - from), ' '))"
    return f"transform(array(split({text}, ' +')), w -> transform(array({fold}), b -> {lines})[0])[0]"


def unused_resources(resources: DataFrame, instructions: DataFrame) -> DataFrame:
    """Resources that no operand of their page names."""
    used = instructions.where(F.col("operator").isin("Do", "Tf", "gs", "cs", "CS", "sh", "scn", "SCN", "BDC", "DP")).select("doc_id", "page_index", F.explode("operands").alias("name"))
    return resources.join(used.distinct(), ["doc_id", "page_index", "name"], "left_anti")
