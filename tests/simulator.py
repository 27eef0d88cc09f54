"""A sequential simulator of SURVEY 1.6: one message after the other, in log order."""

from collections import defaultdict
from itertools import islice, takewhile

from tidemark.model import NULL_KEY


def _text(values):
    return "|".join(NULL_KEY if v is None else v for v in values)


def simulate(rows):
    """rows of changes, as dicts -> {(instance, schema, table, row_key, column): lsn}."""
    ends = defaultdict(lambda: None)
    for r in rows:
        t = (r["instance_name"], r["txn_id"])
        if r["commit_lsn"] is not None:
            ends[t] = max(r["commit_lsn"], ends[t] or 0)
    seen, log = set(), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["action"] not in ("INSERT", "UPDATE", "DELETE") or not r["table_name"] or not r["key_names"]:
            continue
        before, after = r["before_image"] or {}, r["after_image"] or {}
        key = _text([before[k] if k in before else after.get(k) for k in r["key_names"]])
        message = (r["instance_name"], r["lsn"], r["schema_name"] or "", r["table_name"], key)
        if message in seen:
            continue
        seen.add(message)
        end = ends[(r["instance_name"], r["txn_id"])]
        log[(r["instance_name"], r["schema_name"] or "", r["table_name"])].append(((end if end is not None else 1 << 63, r["lsn"]), r, before, after))
    out = {}
    for table, events in log.items():
        state = {}
        events.sort(key=lambda e: e[0])  # stable: by seq within a position
        at = 0
        while at < len(events):
            together = list(takewhile(lambda e: e[0] == events[at][0], islice(events, at, None)))
            at += len(together)
            arrivals = []  # rows of one statement see the state before it
            for (_, lsn), r, before, after in together:
                names = r["key_names"]
                if r["action"] == "INSERT":
                    k = tuple(after.get(n) for n in names)
                    if after and None not in k:
                        state.setdefault(k, {}).update({c: lsn for c in after if c not in names})
                elif r["action"] == "DELETE":
                    k = tuple(before.get(n) for n in names)
                    if before and None not in k:
                        state.pop(k, None)
                else:
                    k = tuple(before[n] if n in before else after.get(n) for n in names)
                    new = tuple(after.get(n, v) if n in after else v for n, v in zip(names, k))
                    if not after or None in k or None in new:
                        continue
                    if new == k:
                        if k in state:
                            state[k].update({c: lsn for c in after if c not in names})
                    elif k in state:
                        row = dict(state[k], **{c: lsn for c in after if c not in names})
                        arrivals.append((k, new, row))
            for k, _, _ in arrivals:
                state.pop(k, None)
            for _, new, row in arrivals:
                state[new] = row
        for k, row in state.items():
            for c, lsn in row.items():
                out[(*table, _text(k), c)] = lsn
    return out
