"""Filters, ordering, paging, joins and writes over note-like tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import PREVIEW_CHARS, preview, stem, tokens

#: English words that full-text search leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values (a primary key with its owner, or a unique name)."""
    return df.where(all_of(*[F.col(k) == v for k, v in keys.items()]))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; none is always true."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def optional_filters(df: DataFrame, **values) -> DataFrame:
    """Equality filters for those values that are not None."""
    return df.where(all_of(*[F.col(k) == v if v is not None else None for k, v in values.items()]))


def among(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose column is one of the values; no values are no filter. Lists are short; longer ones come as a table to join."""
    return df.where(F.col(column).isin(*values)) if values else df


def metadata_is(raw: Column, wanted: Mapping[str, object]) -> Column:
    """Every named field of a JSON object has the wanted value, compared as text; nothing wanted is always true."""
    def text(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    return all_of(*[F.get_json_object(raw, f"$['{k}']") == text(v) for k, v in wanted.items()])


def public_fields(notes: DataFrame, hidden: Sequence[str], texts: Sequence[str], whole: bool = False) -> DataFrame:
    """Notes without the hidden columns; texts as previews with ``<name>_truncated``, unless they are wanted whole."""
    shown = notes.drop(*hidden)
    if whole:
        return shown
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    flags = {f"{c}_truncated": F.length(flat(c)) > PREVIEW_CHARS for c in texts}
    return shown.withColumns(flags).withColumns({c: preview(F.coalesce(c, F.lit(""))) for c in texts})


def contains_text(column: str, needle: str) -> Column:
    """Case-insensitive LIKE; % and _ of the needle stay wild cards."""
    return F.ilike(F.col(column), F.lit(f"%{needle}%"))


def search_terms(text: Column) -> Column:
    """Stemmed lower-case words without stop words."""
    return F.array_distinct(F.transform(F.filter(tokens(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(*STOP_WORDS)), stem))


def full_text(text: Column, query: str) -> Column:
    """Every term of the query is among the text's terms; a query without terms matches nothing."""
    wanted = search_terms(F.lit(query))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, search_terms(text))) == 0)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a total order; skip is at least 0 and limit is held to 1-200."""
    return df.orderBy(*order).offset(max(0, skip)).limit(min(200, max(1, limit)))


def with_names(notes: DataFrame, bridge: DataFrame, names: DataFrame, note: str, name_key: str, name: str, out: str) -> DataFrame:
    """Each note with the sorted array of its names, empty if it has none: the bridge is aggregated before the notes meet it."""
    lists = bridge.select(note, name_key).distinct().join(names.select(name_key, name), name_key).groupBy(note).agg(F.sort_array(F.collect_set(name)).alias(out))
    return notes.join(lists, note, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def ordered_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Each parent with its children as an ordered array of structs."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(out))
    return parents.join(lists, key, "left")


def eligible_messages(messages: DataFrame, roles: Sequence[str] = ("user", "assistant"), exclude: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Messages of the roles that have text; assistant messages only if complete, where there is a status."""
    ok = F.col("role").isin(*roles) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    if "status" in messages.columns:
        ok = ok & ((F.col("role") != "assistant") | (F.col("status") == "complete"))
    out = messages.where(ok)
    return out if exclude is None else out.join(exclude.select(key), key, "left_anti")


def last_n(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key; Spark prunes each task's rows to n a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def first_by(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """One row a key, the first by the order, by a partial aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sets what a change sets: ``changes`` has the key, the columns, and ``fields``, the names of those that it sets (to null, too)."""
    c = changes.select(F.col(key), F.col("fields").alias("_fields"), *[F.col(x).alias(f"_new_{x}") for x in columns])
    joined = rows.join(c, key, "left")
    kept = [F.when(F.array_contains("_fields", x), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in rows.columns]
    return joined.select(*kept)


def cascade_delete(tables: Mapping[str, DataFrame], gone: DataFrame, links: Sequence[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Deletes ``gone`` (keys of the first link's parent column) along links (child table, parent column, the child's own key), parents first."""
    out, lost = dict(tables), {links[0][1]: gone}
    for child, parent, own in links:
        doomed = lost[parent].select(parent).distinct()
        rows = out[child]
        lost[own] = rows.join(doomed, parent, "left_semi").select(own)
        out[child] = rows.join(doomed, parent, "left_anti")
    return out


def upsert(points: DataFrame, arrivals: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Union, of each key the row of the highest version; arrivals win ties."""
    both = points.withColumn("_new", F.lit(0)).unionByName(arrivals.withColumn("_new", F.lit(1)))
    names = points.columns
    best = both.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in names]), F.struct(version, "_new")).alias("_row"))
    return best.select("_row.*")


def replace_documents(points: DataFrame, arrivals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All points of the arrivals' documents go, the arrivals come."""
    return points.join(arrivals.select(doc).distinct(), doc, "left_anti").unionByName(arrivals)


def delete_documents(collections: Mapping[str, DataFrame | None], gone: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Deletes documents from every collection that exists."""
    ids = gone.select(doc).distinct()
    return {name: df.join(ids, doc, "left_anti") for name, df in collections.items() if df is not None}


def by_identity(points: DataFrame, identities: DataFrame) -> DataFrame:
    """Points named by (doc_id, chunk_id), where ``*`` names all chunks of a document. No identities: no points."""
    whole = identities.where("chunk_id = '*'").select("doc_id").distinct()
    some = identities.where("chunk_id <> '*'").select("doc_id", "chunk_id").distinct()
    marked = points.join(whole.withColumn("_whole", F.lit(True)), "doc_id", "left").join(some.withColumn("_some", F.lit(True)), ["doc_id", "chunk_id"], "left")
    return marked.where("_whole OR _some").drop("_whole", "_some")


def keep_allowed(rows: DataFrame, name: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """Deny wins; an empty allow list allows all."""
    ok = ~F.col(name).isin(*deny) if deny else F.lit(True)
    return rows.where(ok & F.col(name).isin(*allow)) if allow else rows.where(ok)


def qualified_names(tools: DataFrame, name: str = "name", owner: str = "server") -> DataFrame:
    """Names that several owners have are qualified by the owner."""
    count = tools.groupBy(name).agg(F.count("*").alias("_n"))
    return tools.join(count, name).withColumn("qualified", F.when(F.col("_n") > 1, F.concat_ws(":", F.col(owner), F.col(name))).otherwise(F.col(name))).drop("_n")
