"""Fill-in-the-middle training texts by a counted-quantifier regular expression.

A text is a row of units, its lines.  `regexp_count` gives their number n, a
hash of the document's id picks two cut points a <= b of the n + 1, and a
pattern made for the row takes a units, b - a units and the rest as three
groups of one match; the replacement that names the groups in the order of the
form writes the training text.  The quantifiers are possessive: a counted group
that never gives back is a loop, so neither the number of lines nor the length
of the text deepens the match or makes it try again.  Everything is an
expression of Spark, evaluated where the row is read: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, fresh

#: A line with its line break, or the last one without.
_UNIT = r"(?:[^\n]*+\n|[^\n]++)"


@dataclass(frozen=True)
class InfillParams:
    """seed: names the cuts; another seed, other cuts.  rate: percent of the
    texts to cut.  spm: percent of those in the order suffix, prefix, middle
    (the others: prefix, suffix, middle).  prefix, suffix, middle: the markers;
    each starts with a character that occurs in no marker again, so a marker
    never arises where a text and a marker meet."""
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.prefix, self.suffix, self.middle
        if len(set(marks)) < 3 or not all(marks) or len({m[0] for m in marks}) > 1 or any(marks[0][0] in m[1:] for m in marks) \
                or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("markers have to differ, and to share a first character that they hold once")


def _draws(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _quoted(mark: str) -> str:
    """A marker as it stands in a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", params: InfillParams = InfillParams(),
                   output: str = "fim_text", form: str = "fim_form", units: str = "fim_units") -> DataFrame:
    """`docs` with the training text, its form (plain, psm or spm) and the number of lines.

    A null text counts as empty.  An empty text, one that holds a marker and
    one beyond `rate` stay as they are: form plain.  A null id draws as an
    empty one.  Rows are independent: repeated ids get the same draws, repeated
    rows the same result.  Columns of `docs` stay; the three names must be new.
    """
    t = F.coalesce(col(text), F.lit(""))
    n = F.regexp_count(t, F.lit(_UNIT)).cast("long")
    out = docs.withColumn(units, n)
    h1, h2, h3, h4 = _draws(key, params.seed)
    x, y = h1 % (col(units) + 1), h2 % (col(units) + 1)
    marked = F.lit(False)
    for m in (params.prefix, params.suffix, params.middle):
        marked = marked | F.contains(t, F.lit(m))
    plain = (t == "") | marked | (h3 % 100 >= params.rate)
    out = out.withColumn(form, F.when(plain, "plain").when(h4 % 100 < params.spm, "spm").otherwise("psm"))
    first, both = fresh(out, "first"), fresh(out, "both")
    out = out.withColumn(first, F.least(x, y)).withColumn(both, F.greatest(x, y))
    pattern = F.format_string(rf"(?s)\A({_UNIT}{{%d}}+)({_UNIT}{{%d}}+)(.*+)\z", col(first), col(both) - col(first))
    p, s, m = map(_quoted, (params.prefix, params.suffix, params.middle))
    order = F.when(col(form) == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    return out.withColumn(output, F.when(col(form) == "plain", t).otherwise(F.regexp_replace(t, pattern, order))) \
        .drop(first, both)


def parts(output: str, form: str, params: InfillParams = InfillParams()) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix read back from a training text; null where the form is plain."""
    def between(a: str, b: str | None) -> Column:
        rest = F.substring_index(col(output), a, -1)
        return rest if b is None else F.substring_index(rest, b, 1)
    spm = col(form) == "spm"
    p, s, m = params.prefix, params.suffix, params.middle
    cut = col(form) != "plain"
    return (F.when(cut, F.when(spm, between(p, m)).otherwise(between(p, s))), F.when(cut, between(m, None)),
            F.when(cut, F.when(spm, between(s, p)).otherwise(between(s, m))))


def restored(output: str, form: str, params: InfillParams = InfillParams()) -> Column:
    """The text a training text was made of."""
    return F.when(col(form) == "plain", col(output)).otherwise(F.concat(*parts(output, form, params)))


#: DuckDB SQL for the digest of `fill_in_middle` over documents, by lists of lines.
ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
         sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
c as (
  select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
e as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from c),
p as (
  select doc_id, n, form, t, array_to_string(list_slice(u, 1, a), '') as pre,
         array_to_string(list_slice(u, a + 1, b), '') as mid, array_to_string(list_slice(u, b + 1, n), '') as suf from e)
select doc_id, n, form,
       case when form <> 'plain' then length(pre)::bigint end as prefix_chars,
       case when form <> 'plain' then length(mid)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from p
"""
