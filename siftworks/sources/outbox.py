"""Effects outside as rows of a table: messages and cards, each sent once however often a run is repeated (K15, K16, L15, T6s).

A run puts what it wants done under a key of its run, node and target; what is there already stays as it is. A sender
claims waiting effects, acts, and marks them, each in a write of its own:

    waiting -> claimed -> done -> settled

One that a broken pass left claimed may or may not have happened: the service is asked for its key and only acts if it
knows of none. What hangs on a result, such as rows with the id of a message, is written from the table too, so it is
not lost between the act and the run's next step. An effect that fails waits again, with its error.
"""

from __future__ import annotations

import hashlib
import json
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.models.interfaces import Board, Notifier
from siftworks.operators.cut import cut
from siftworks.schemas import STORE
from siftworks.sources.store import TableStore

#: Effects that one claim takes.
CLAIM = 100


def effect(run_id: str, node: str, target: str, kind: str, payload: dict, follow: list[tuple[str, dict]] = (), after: str | None = None) -> dict:
    """An effect of kind send (text, markup), create (title, list_id, description) or update (card_id, description).

    after is the key of an effect whose result the text names as $name and $url. follow has rows of tables in which the
    value $id stands for the id of the message or card.
    """
    key = hashlib.sha256("\x1f".join((run_id, node, target)).encode()).hexdigest()
    return {"effect_id": key, "run_id": run_id, "node": node, "target": target, "kind": kind, "payload": json.dumps(payload), "after": after, "follow": json.dumps(list(follow)), "status": "waiting", "tries": 0}


def put(store: TableStore, effects: list[dict], now: str) -> None:
    """Adds those effects that the table has not, in their order."""
    if effects:
        put_rows(store, store.spark.createDataFrame([e | {"seq": i} for i, e in enumerate(effects)], STORE["outbox"][0]), now)


def put_rows(store: TableStore, rows: DataFrame, now: str) -> None:
    """put for effects that are a table."""
    new = rows.join(store.read("outbox").select("effect_id"), "effect_id", "left_anti").withColumns({"created_at": F.lit(now), "changed_at": F.lit(now)})
    store.upsert("outbox", cut(new))


def _act(e: dict, notifier: Notifier, board: Board, results: dict[str, dict]) -> dict:
    p, key = json.loads(e["payload"]), e["effect_id"]
    if e["kind"] == "send":
        text = Template(p["text"]).safe_substitute(results[e["after"]]) if e["after"] else p["text"]
        return {"id": notifier.send(text, p.get("markup", "HTML"), key)}
    if e["kind"] == "create":
        return board.create(p["title"], p["list_id"], p["description"], key)
    return board.update(p["card_id"], p["description"])


def _found(e: dict, notifier: Notifier, board: Board) -> dict | None:
    """What a service knows of an effect's key. A card that is set to a text again is the same card, so updates need no answer."""
    if e["kind"] == "send":
        known = notifier.find(e["effect_id"])
        return None if known is None else {"id": known}
    return board.find(e["effect_id"]) if e["kind"] == "create" else None


def _marked(store: TableStore, rows: list[dict], now: str) -> None:
    if rows:
        store.upsert("outbox", store.spark.createDataFrame([r | {"changed_at": now} for r in rows], STORE["outbox"][0]))


def _follow(store: TableStore, done: list[dict]) -> None:
    """Writes what follows from results; written again, it is the same."""
    tables: dict[str, list[dict]] = {}
    for e in done:
        ident = json.loads(e["result"]).get("id")
        for name, row in json.loads(e["follow"] or "[]"):
            tables.setdefault(name if STORE[name][1] else f"{name} {e['effect_id']}", []).append({c: ident if v == "$id" else v for c, v in row.items()})
    for what, rows in tables.items():
        name = what.split(" ")[0]
        df = store.spark.createDataFrame([tuple(r.get(f) for f in store.columns(name)) for r in rows], STORE[name][0])
        if name == what:
            store.upsert(name, df)
        else:
            store.append(name, df, once=what)


def send_waiting(store: TableStore, notifier: Notifier, board: Board, now: str) -> dict[str, str]:
    """Sends what waits, in order, and gives the errors by key. One pass at a time is assumed, as one writer a table is.

    An effect that comes after another one waits until that one is done. At most CLAIM effects are at the driver at once.
    """
    errors: dict[str, str] = {}
    while True:
        table = store.read("outbox")
        ready = table.alias("e").join(table.where("status IN ('done', 'settled')").select(F.col("effect_id").alias("__a"), F.col("result").alias("__result")), F.col("e.after") == F.col("__a"), "left")
        ready = ready.where("e.status IN ('waiting', 'claimed', 'done') AND (e.after IS NULL OR __a IS NOT NULL)")
        if errors:
            ready = ready.where(~F.col("effect_id").isin(list(errors)))
        batch = [r.asDict() for r in ready.orderBy("created_at", "seq", "effect_id").limit(CLAIM).select("e.*", "__result").collect()]
        if not batch:
            return errors
        results = {e["after"]: json.loads(e["__result"]) for e in batch if e["after"]}
        for e in batch:
            e.pop("__result")
        _marked(store, [e | {"status": "claimed"} for e in batch if e["status"] == "waiting"], now)
        done = [e for e in batch if e["status"] == "done"]
        failed = []
        for e in batch:
            if e["status"] == "done":
                continue
            try:
                got = (_found(e, notifier, board) if e["status"] == "claimed" else None) or _act(e, notifier, board, results)
            except Exception as x:  # the service's failure is data here
                errors[e["effect_id"]] = str(x)[:500]
                failed.append(e | {"status": "waiting", "tries": e["tries"] + 1, "error": str(x)[:500]})
                continue
            done.append(e | {"status": "done", "result": json.dumps(got), "error": None})
        _marked(store, done + failed, now)
        if done:
            _follow(store, done)
            _marked(store, [e | {"status": "settled"} for e in done], now)
