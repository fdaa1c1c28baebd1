"""Running state over the fragments of documents, as window expressions: skipped zones and paragraph starts.

The Arrow function text.segments gives the same in one pass without a shuffle
and is what the operators use; this form is for queries over single fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def fragment_rows(docs: DataFrame, key: list[str], markup: str = "html") -> DataFrame:
    """key, ord, fragment, is_tag, in_skip, at_para for each fragment of each document.

    The depth of skipped zones never falls under 0: a running sum less the least it has been below 0 so far."""
    rows = docs.select(*key, F.posexplode(T.fragments(markup)).alias("ord", "fragment"))
    by = Window.partitionBy(*key).orderBy("ord")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    f = F.col("fragment")
    rows = rows.withColumn("is_tag", T.is_tag(f)).withColumn("__d", T.skip_step(f)).withColumn("__s", F.sum("__d").over(upto))
    depth = F.col("__s") - F.least(F.lit(0), F.min("__s").over(upto))
    rows = rows.withColumn("in_skip", depth > 0)
    name = T.tag_name(f)
    comment, closing = f.startswith("<!--"), f.startswith("</")
    event = (
        F.when(F.col("is_tag") & ~comment & closing & (name == "p"), False)
        .when(F.col("is_tag") & ~comment & ~closing & (name == "p"), True)
        .when(F.col("is_tag") & ~comment & ~closing & ~name.isin(*T.INLINE, "br"), False)
        .when(~F.col("is_tag") & ~F.col("in_skip") & (T.strip(f) != ""), False)
    )
    rows = rows.withColumn("__e", event)
    at = F.coalesce(F.last("__e", ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("at_para", at & ~F.col("is_tag") & ~F.col("in_skip")).drop("__d", "__s", "__e")
