"""The long form of a table: a row for each filled cell. Wide sparse tables never become wide plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.hashing import order_key, u01
from quernstone.functions.text import corrupt_value, is_blank, pick, strip, tokenize


def feature_columns(df: DataFrame, id_col: str = "id") -> list[str]:
    return [c for c in df.columns if c != id_col]


def to_cells(df: DataFrame, id_col: str = "id", keep_blank: bool = False) -> DataFrame:
    """(id, col, val string); null and blank cells are left out unless asked for."""
    features = feature_columns(df, id_col)
    text = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("string").alias(c) for c in features))
    cells = text.unpivot("id", features, "col", "val")
    return cells if keep_blank else cells.where(~is_blank(F.col("val")))


def column_stats(cells: DataFrame) -> DataFrame:
    """(col, n_rows, n_filled, n_unique) of cells with blanks kept."""
    return cells.groupBy("col").agg(F.count("*").alias("n_rows"), F.count("val").alias("n_filled"), F.count_distinct("val").alias("n_unique"))


def min_notnull(df: DataFrame, least: int, id_col: str = "id") -> DataFrame:
    """Rows with at least that many features filled."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in feature_columns(df, id_col)), F.lit(0))
    return df.where(filled >= least)


def dropped_columns(columns: list[str], rate: float, seed: int) -> list[str]:
    """int(n * rate) of the columns, by hash."""
    import hashlib

    ordered = sorted(columns, key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest())
    return sorted(ordered[: int(len(columns) * rate)])


def corrupt_cells(cells: DataFrame, seed: int, row_prob: float = 0.5, cell_prob: float = 0.4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the rows that a first draw takes are corrupted where a second one does."""
    hit = (u01(seed, F.lit("row"), F.col("id")) < row_prob) & (u01(seed, F.lit("cell"), F.col("id"), F.col("col")) < cell_prob)
    if skip:
        hit = hit & ~F.col("col").isin(*skip)
    return cells.withColumn("val", F.when(hit, corrupt_value(F.col("val"), seed, F.col("id"), F.col("col"))).otherwise(F.col("val")))


def apply_synonyms(cells: DataFrame, column_synonyms: DataFrame, value_synonyms: DataFrame, seed: int, col_prob: float = 0.75, val_prob: float = 0.6) -> DataFrame:
    """Each column gets one synonym for all its rows or none; each cell one for its value or none.

    column_synonyms (col, syns), value_synonyms (col, val, vsyns): dictionaries, joined by key.
    """
    out = cells.join(column_synonyms, "col", "left").join(value_synonyms, ["col", "val"], "left")
    value = F.when(u01(seed, F.lit("v"), F.col("id"), F.col("col")) < val_prob, pick(F.col("vsyns"), seed + 1, F.col("id"), F.col("col")))
    name = F.when(u01(seed, F.lit("c"), F.col("col")) < col_prob, pick(F.col("syns"), seed + 1, F.col("col")))
    return out.select("id", F.coalesce(name, F.col("col")).alias("col"), F.coalesce(value, F.col("val")).alias("val"))


def make_view(cells: DataFrame, n_rows: int, column_synonyms: DataFrame, value_synonyms: DataFrame, seed: int, min_fill: float = 0.05, drop: list[str] | None = None) -> DataFrame:
    """A supplier's view: dense columns, renamed and reworded, some columns lost, some cells corrupted."""
    dense = cells.groupBy("col").agg(F.count("*").alias("n")).where(F.col("n") >= min_fill * n_rows).select("col")
    view = cells.join(dense, "col", "left_semi")
    if drop:
        view = view.where(~F.col("col").isin(*drop))
    return corrupt_cells(apply_synonyms(view, column_synonyms, value_synonyms, seed), seed)


def tokens_of(cells: DataFrame) -> DataFrame:
    """(id, col, pos, tok): different tokens of each cell by first place."""
    return cells.select("id", "col", F.posexplode(F.array_distinct(tokenize(F.col("val")))).alias("pos", "tok"))


def first_tokens(toks: Column, most: int, seed: int) -> Column:
    """The array's first tokens by hash, of the cell `id`, `col`; ties by token, as in capped()."""
    keyed = F.transform(toks, lambda x: F.struct(order_key(seed, F.col("id"), F.col("col"), x).alias("key"), x.alias("tok")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["tok"])


def capped(tokens: DataFrame, most: int, seed: int) -> DataFrame:
    """At most that many tokens of a cell, by hash."""
    from quernstone.operators.ranking import top_n

    return top_n(tokens, ["id", "col"], most, order_key(seed, F.col("id"), F.col("col"), F.col("tok")), F.col("tok"), name="cap_").drop("cap_")


def capped_cells(cells: DataFrame, most: int, seed: int) -> DataFrame:
    """(id, col, tok): capped() of the different tokens of cells, whole ones. Each cell is cut as an array first, so only so many of its tokens become rows."""
    own = F.array_distinct(tokenize(F.col("val"), None))
    return capped(cells.select("id", "col", F.explode(first_tokens(own, most, seed)).alias("tok")), most, seed)


def normalised(c):
    return F.lower(strip(c))


#: Names of columns that hold ids, and the bounds of the kinds.
ID_NAME = r"(?i)(^|[._])(id|url|link|image|hash|guid|uuid|src|sell_id|timestamp|unixtime|date|артикул|ссылка)([._]|$)"
UNIQUE_SHARE, TEXT_LENGTH, LENGTH_SAMPLE, MOST_CATEGORIES = 0.95, 80, 1000, 1000


def classify_columns(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(col, fill, n_unique, avg_len, kind) of each column but the id.

    kind: datetime, binary (boolean, or two values), list_dict (nested), constant, numeric, id_like (by name, or nearly all values
    different), text (long), categorical, high_card. The mean length is that of the first values by id, as the definition has it.
    """
    kinds = {}
    for name, t in df.dtypes:
        if name != id_col:
            kinds[name] = "datetime" if t in ("date", "timestamp", "timestamp_ntz") else "binary" if t == "boolean" else "list_dict" if t.startswith(("array", "map", "struct")) else "string" if t == "string" else "number"
    shown = df.select(F.col(id_col).alias("id"), *(F.to_json(c).alias(c) if k == "list_dict" else F.col(c).cast("string").alias(c) for c, k in kinds.items()))
    cells = shown.unpivot("id", list(kinds), "col", "val")
    stats = column_stats(cells)
    from quernstone.operators.ranking import top_n

    head = top_n(cells.where("val is not null"), ["col"], LENGTH_SAMPLE, F.col("id"), name="k").groupBy("col").agg(F.avg(F.length("val")).alias("avg_len"))
    types = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("col"))
    s = stats.join(head, "col", "left").withColumn("type", types)
    n, share = F.col("n_unique"), F.col("n_unique") / F.greatest(F.col("n_filled"), F.lit(1))
    kind = (
        F.when(F.col("type").isin("datetime", "binary", "list_dict"), F.col("type")).when(n <= 1, "constant").when((F.col("type") == "number") & (n == 2), "binary").when(F.col("type") == "number", "numeric")
        .when(F.col("col").rlike(ID_NAME) | (share > UNIQUE_SHARE), "id_like").when(F.col("avg_len") > TEXT_LENGTH, "text").when(n == 2, "binary").when(n <= MOST_CATEGORIES, "categorical").otherwise("high_card")
    )
    return s.select("col", (F.col("n_filled") / F.col("n_rows")).alias("fill"), "n_unique", "avg_len", kind.alias("kind"))
