"""The digest and the plan as text.

Lines come from DataFrame columns; only the bounded lists that a message shows reach the driver, which joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.functions.rules import section
from siftworks.functions.text import escape_html, truncate

SHOWN, SOFT_LIMIT, FIRST_CAP, LAST_CAP = 15, 3900, 150, 20
ORDER = {"reading": 1, "courses": 2, "existing_project_work": 3, "uncategorized": 4}
MAP = ["item_number", "url", "title", "text", "tags", "reasoning", "section"]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with item_number, one count over the sections in their order, then pos (W3). Rows are those of one message."""
    order = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("section")]
    return rows.withColumn("item_number", F.row_number().over(Window.orderBy(order, "pos")))


def _head(title: str = "title", text: str = "text") -> Column:
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), text), 1, 80)


def cost_line(costs: dict[str, float] | None) -> str:
    """Total, and two of the providers; others are in the total alone."""
    if not costs:
        return ""
    return "<i>Cost: ${:.4f} (Anthropic: ${:.4f}, NVIDIA embeddings: ${:.4f})</i>".format(*(costs.get(k, 0.0) for k in ("total", "anthropic", "nvidia")))


def uncategorized_entries(rows: DataFrame) -> DataFrame:
    reason = F.format_string("closest existing tag: %s (cosine=%.3f)", "best_tag", "similarity_score")
    return rows.select("url", _head().alias("title"), "text", F.array(F.lit("uncategorized")).alias("tags"), reason.alias("reasoning"), F.lit("uncategorized").alias("section"), "pos")


def digest_entries(scored: DataFrame, uncategorized: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The numbered entries of a digest: the first kept items, then all without a topic."""
    kept = scored.where("keep").orderBy("pos").limit(shown).select("url", _head().alias("title"), "text", "tags", "reasoning", F.lit("reading").alias("section"), "pos")
    return numbered(kept.unionByName(uncategorized_entries(uncategorized)))


def digest(scored: DataFrame, uncategorized: DataFrame, run_id: str, costs: dict[str, float] | None = None, shown: int = SHOWN) -> tuple[str, list[dict]]:
    """The digest's text and its item map."""
    n = scored.agg(F.count("*").alias("all"), F.count_if("keep").alias("kept")).first()
    entries = digest_entries(scored, uncategorized, shown)
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<code>"), escape_html(t), F.lit("</code>"))), " ")
    head = F.concat(F.col("item_number").cast("string"), F.lit('. <a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(F.col("title")), F.lit("</a>"))
    why = F.concat(F.lit("   <i>"), escape_html(F.col("reasoning")), F.lit("</i>"))
    lines = F.when(F.col("section") == "uncategorized", F.array(head, why, F.lit(""))).otherwise(F.array(head, F.concat(F.lit("   Tags: "), tags), why, F.lit("")))
    rows = entries.withColumn("lines", lines).orderBy("item_number").collect()
    title, cost = "🤖 <b>Daily Digest</b>", cost_line(costs)
    if not rows:
        return f"{title}\n\n<i>Nothing new today.</i>" + (f"\n\n{cost}" if cost else ""), []
    first = [r for r in rows if r.section != "uncategorized"]
    last = rows[len(first) :]
    out = [title, ""] + ([x for r in first for x in r.lines] if first else ["<i>Nothing new today.</i>", ""])
    if last:
        out += [f"<b>{len(last)} item(s) didn't match any existing topic</b>", *[x for r in last for x in r.lines]]
    out.append(f"<i>{n['all']} scored · {min(n.kept, shown)}/{n.kept} shown · {len(last)} uncategorized · run: {run_id[:8]}</i>")
    return "\n".join(out + [cost] * bool(cost)), [{k: r[k] for k in MAP} for r in rows]


def plan_entries(items: DataFrame, projects: DataFrame, uncategorized: DataFrame) -> DataFrame:
    """The numbered entries of a plan: reading, courses, project work by rank, and items without a topic."""
    plain = items.where("classification = 'plan_item'").withColumn("section", section(F.coalesce("tags", F.array().cast("array<string>")), F.col("matched_card_id"), F.lit(False))).where("section IS NOT NULL")
    plain = plain.select("url", _head().alias("title"), "text", "tags", "reasoning", "section", "pos")
    work = projects.select("url", "title", "text", "tags", "reasoning", F.lit("existing_project_work").alias("section"), F.col("rank").cast("long").alias("pos"), "card_name", F.col("source").alias("entry_source"))
    return numbered(plain.unionByName(work, allowMissingColumns=True).unionByName(uncategorized_entries(uncategorized), allowMissingColumns=True))


def _plan_text(rows: DataFrame, cap: int | None, pending: int, run_id: str, cost: str) -> str:
    cut = (lambda c: truncate(c, cap)) if cap else (lambda c: c)
    why = F.concat(F.lit("   <i>"), escape_html(cut(F.col("reasoning"))), F.lit("</i>"))
    more = F.when(F.col("entry_source") == "stale_nudge", F.lit(" — ⏳ idle board item, no new content this week")).when(F.col("section") == "existing_project_work", F.concat(F.lit(' — continues card: "'), escape_html(cut(F.col("card_name"))), F.lit('"'))).otherwise(F.lit(""))
    head = F.concat(F.col("item_number").cast("string"), F.lit('. <a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(F.col("title")), F.lit("</a>"))
    got = rows.select("item_number", "section", F.array(head, F.concat(why, more), F.lit("")).alias("lines")).orderBy("item_number").collect()
    by = {s: [r for r in got if r.section == s] for s in ORDER}
    names = {"reading": "Reading & Learning", "courses": "Courses", "existing_project_work": "Existing Project Work", "uncategorized": f"{len(by['uncategorized'])} item(s) didn't match any existing topic"}
    out = ["📋 <b>Weekly Plan</b>", ""]
    for s, rs in by.items():
        if rs:
            out += [f"<b>{names[s]}</b>", *[x for r in rs for x in r.lines]]
    foot = [f"{len(got) - len(by['uncategorized'])} plan items"] + [f"{len(by['uncategorized'])} uncategorized"] * bool(by["uncategorized"]) + [f"{pending} proposals pending approval"] * (pending > 0) + [f"run: {run_id[:8]}"]
    return "\n".join([*out, f"<i>{' · '.join(foot)}</i>"] + [cost] * bool(cost))


def plan(items: DataFrame, projects: DataFrame, uncategorized: DataFrame, pending: int, run_id: str, costs: dict[str, float] | None = None, limit: int = SOFT_LIMIT) -> tuple[str, list[dict]]:
    """The plan's text and its item map. A text over the limit is made again with reasons cut, first to 150 characters and then to half as many while over 20; the map keeps them whole."""
    rows = plan_entries(items, projects, uncategorized).persist()
    try:
        told = [{k: r[k] for k in MAP} for r in rows.orderBy("item_number").collect()]
        cost = cost_line(costs)
        if not told:
            more = f" {pending} proposals pending approval — check Telegram." if pending > 0 else ""
            return f"📋 <b>Weekly Plan</b>\n\n<i>Nothing on the plan this week.{more}</i>" + (f"\n\n{cost}" if cost else ""), []
        text, cap = _plan_text(rows, None, pending, run_id, cost), FIRST_CAP
        if len(text) > limit:
            text = _plan_text(rows, cap, pending, run_id, cost)
            while len(text) > limit and cap > LAST_CAP:
                cap //= 2
                text = _plan_text(rows, cap, pending, run_id, cost)
        return text, told
    finally:
        rows.unpersist()


def block(rows: DataFrame, line: Column, pos: str = "pos") -> DataFrame:
    """One row, text: the lines of a bounded list in order, for a prompt."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def item_line() -> Column:
    return F.concat(F.col("url"), F.lit(" | "), F.substring(F.coalesce("title", F.lit("")), 1, 100), F.lit(" | "), F.substring(F.coalesce("reasoning", F.lit("")), 1, 150))


def score_line() -> Column:
    return F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 500))


def numbered_line() -> Column:
    return F.concat(F.col("item_number").cast("string"), F.lit(". "), F.coalesce(F.nullif("title", F.lit("")), F.nullif("url", F.lit("")), F.lit("unknown")))
