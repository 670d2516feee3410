"""Keyed state: the sliding-log rate limiter and the store of results with expiry and a size cap.

The state machines are plain functions over ordered events; they run over tables (`applyInPandas`) and over
streams (`applyInPandasWithState`) alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def client_key(peer, forwarded=None, behind_proxy: bool = False):
    """The column that names a client: the peer, or the first forwarded address behind a known proxy."""
    if not behind_proxy or forwarded is None:
        return F.coalesce(peer, F.lit("unknown"))
    first = F.btrim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    return F.when(first != "", first).otherwise(F.coalesce(peer, F.lit("unknown")))


def admit(stamps: list[float], now: float, limit: int, window: float) -> tuple[bool, list[float]]:
    """Whether a request is let in, and the log afterwards. Refused requests are not logged."""
    live = [t for t in stamps if t > now - window]
    return (False, live) if len(live) >= limit else (True, [*live, now])


def _admitted(times: Iterable[float], stamps: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    out = []
    for now in times:
        ok, stamps = admit(stamps, now, limit, window)
        out.append(ok)
    return out, stamps


def rate_limit(requests: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """client, request, at (seconds): adds `accepted`. A client's requests are read in (at, request) order, a batch at a time.

    Acceptance depends on earlier acceptances, so a client is one task's work; only its log (at most `limit` stamps) is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, stamps = None, []
        for batch in batches:
            ok = []
            for c, at in zip(batch["client"], batch["at"], strict=True):
                if c != client:
                    client, stamps = c, []
                accepted, stamps = admit(stamps, at, limit, window)
                ok.append(accepted)
            yield batch.assign(accepted=ok)

    ordered = requests.select("client", "request", "at").repartition("client").sortWithinPartitions("client", "at", "request")
    return ordered.mapInPandas(run, "client string, request long, at double, accepted boolean")


def rate_limit_stream(requests: DataFrame, limit: int = 60, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """The limiter over a stream of (client string, request long, at double, in seconds).

    Logs expire by event time: once the watermark, `delay` behind the latest request, has passed a log's last stamp by the
    window. So a replayed backlog is judged as it was live. Requests behind the watermark are not judged and give no row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request"])
        ok, stamps = _admitted(rows["at"], list(state.get[0]) if state.exists else [], limit, window)
        state.update((stamps,))
        state.setTimeoutTimestamp(max(int((max(stamps, default=rows["at"].max()) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(accepted=ok)[["client", "request", "at", "accepted"]]

    timed = requests.withColumn("seen", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("seen", delay)
    return timed.groupBy("client").applyInPandasWithState(run, "client string, request long, at double, accepted boolean", "stamps array<double>", "append", GroupStateTimeout.EventTimeTimeout)


#: What a store holds: token to (time put, value), the least recently used first.
Held = dict[str, tuple[float, str]]


def answered(held: Held, op: str, token: str, value: str, now: float, ttl: float = 1800, most: int = 200) -> tuple[Held, str | None]:
    """One operation on a store: what it holds afterwards, and the answer.

    Results live less than `ttl` seconds after they were put (0: never), and beyond `most` the least recently used go.
    A result that is read becomes the latest used, but lives no longer for it. put answers the token, get the value or
    nothing, discard whether there was one, size how many there are; clear answers nothing.
    """
    live = held if op in ("discard", "clear") else {t: e for t, e in held.items() if now - ttl < e[0]}
    others = {t: e for t, e in live.items() if t != token}
    if op == "put":
        every = [*others.items(), (token, (now, value))]
        return dict(every[max(0, len(every) - most) :]), token
    if op == "get" and token in live:
        return others | {token: live[token]}, live[token][1]
    if op == "discard":
        return others, str(token in live).lower()
    return ({}, None) if op == "clear" else (live, str(len(live)) if op == "size" else None)


def store_stream(operations: DataFrame, ttl: float = 1800, most: int = 200) -> DataFrame:
    """(shard, n long, op, token, value, at double) to (shard, n, op, token, answer): `answered`, folded over a shard's operations by n.

    A store's size is bounded by `most`; its cap needs all of a shard under one key.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: Held = {t: (at, v) for t, at, v in zip(*state.get, strict=True)} if state.exists else {}
        rows, answers = pd.concat(list(batches)).sort_values("n"), []
        for r in rows.itertuples():
            held, answer = answered(held, r.op, r.token, r.value, r.at, ttl, most)
            answers.append(answer)
        state.update((list(held), [at for at, _ in held.values()], [v for _, v in held.values()]))
        yield rows.assign(answer=answers)[["shard", "n", "op", "token", "answer"]]

    return operations.groupBy("shard").applyInPandasWithState(run, "shard string, n long, op string, token string, answer string", "tokens array<string>, ats array<double>, vals array<string>", "append", GroupStateTimeout.NoTimeout)
