"""Text for people. Values become text as Spark columns; what is left here is the layout: blocks of aligned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import analytics

#: Lines of a hit that are shown, characters of a query that are shown.
SNIPPET_LINES, QUERY_CHARS = 8, 50
NOTHING = "The log of searches is empty.\n"


def aligned(rows: list[tuple], titles: tuple[str, ...] = ()) -> str:
    """Rows as columns of equal width, two blanks apart."""
    cells = [[str(c) for c in row] for row in ([titles] if titles else []) + rows]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() + "\n" for row in cells)


def shortened(text: Column, most: int = QUERY_CHARS) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def shown(hits: DataFrame) -> DataFrame:
    """Adds ``bar``, the score as a bar."""
    return hits.withColumn("bar", tx.score_bar(F.greatest("score", F.lit(0.0))))


def snippet(content: str, most: int = SNIPPET_LINES) -> str:
    """The first lines of a text, and how many follow."""
    lines = content.splitlines()
    return "\n".join(lines[:most] + ([f"… {len(lines) - most} more lines"] if len(lines) > most else []))


def results(hits: list[dict], query: str, windows: list[str | None] | None = None, radius: int = 1) -> str:
    """Hits (rows of ``shown``) for a terminal. A window takes the place of the snippet; ``source_db`` is named where several indexes were asked."""
    blocks = [f"{query!r}: {len(hits)} found"]
    named = len({h.get("source_db") for h in hits}) > 1
    bodies = [w for w in windows or []] + [None] * len(hits)
    for n, (hit, window) in enumerate(zip(hits, bodies, strict=False), 1):
        where = " § ".join(x for x in (hit["file_path"], hit["heading_context"]) if x) + (f" [{hit['source_db']}]" if named else "")
        body = snippet(hit["content"]) if window is None else f"(with {radius} before and after)\n{window}"
        blocks.append(f"{n}. {where}\n{hit['bar']} {hit['score']:.3f}\n{body}")
    return "\n\n".join(blocks) + "\n"


def status(stats: dict, path: str, model_id: str) -> str:
    """The state of an index; see ``Bank.stats``."""
    n, mega = stats["documents"], lambda b: f"{b / (1 << 20):.1f} MB"
    rows = [
        ("index", path), ("model", f"{model_id}, {stats['embedding_dim']} numbers"), ("documents", f"{n}, {mega(stats['total_bytes'])}"),
        ("chunks", f"{stats['chunks']}, {stats['chunks'] / n:.1f} a document" if n else f"{stats['chunks']}, — a document"),
        ("size", mega(stats["index_bytes"])), ("last change", stats["last_indexed_at"] or "never"),
    ]
    return aligned(rows + ([("⚠", f"{stats['empty_documents']} documents have no chunks")] if stats["empty_documents"] else []))


def savings(log: DataFrame) -> str:
    """What searches delivered against reading whole files."""
    totals = analytics.costs(analytics.savings(log))
    count = lambda part: tx.human_count(F.col(f"{part}_tokens")).alias(f"{part}_count")
    rows = [r.asDict() for r in totals.select("*", tx.iso_time(F.col("since")).alias("since_time"), *map(count, ("baseline", "delivered", "saved"))).collect()]
    whole = next(r for r in rows if r["source"] is None)
    if not whole["searches"]:
        return NOTHING
    by = ", ".join(f"{r['searches']} {r['source']}" for r in sorted(rows, key=lambda r: r["source"] or "") if r["source"])
    head = f"{whole['searches']} searches since {whole['since_time'][:10]}" + (f" ({by})" if by else "")
    lines = [(name, whole[f"{part}_count"], f"${whole[f'{part}_dollars']:.2f}") for name, part in (("whole files", "baseline"), ("delivered", "delivered"), ("saved", "saved"))]
    return f"{head}; {whole['multiplier']:.1f} times fewer tokens, at 4 bytes a token\n{aligned(lines, ('', 'tokens', 'cost'))}"


def history(log: DataFrame, n: int) -> str:
    """The ``n`` newest searches."""
    given, whole = (tx.bytes_to_tokens(F.col(c)) for c in ("result_bytes", "baseline_bytes"))
    spared = tx.human_count(F.greatest(whole - given, F.lit(0)))
    rows = analytics.recent(log, n).select(tx.iso_time(F.col("ts")), "source", "top_k", tx.human_count(given), spared, shortened(F.col("query"))).collect()
    return aligned([tuple(r) for r in rows], ("time", "from", "hits", "tokens", "saved", "query")) if rows else NOTHING
