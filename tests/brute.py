"""Plain sequential versions of the ordered rules, for small fixtures only."""


def runs(rows, active, inactivity, linger):
    """rows: [(key, t, seq, closes)] -> {(key, seq): (run_seq or None, absorbed)}."""
    out, state = {}, {}
    for key, t, seq, closes in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.get(key)
        if s is not None and s["closed"] is not None:
            new = t - s["closed"] > linger
        else:
            new = s is None or t - s["last"] >= inactivity or t - s["start"] >= active
        if new:
            s = state[key] = {"start": t, "seq": seq, "closed": None}
        elif s["closed"] is not None:
            out[key, seq] = (None, True)
            continue
        s["last"] = t
        if closes:
            s["closed"] = t
        out[key, seq] = (s["seq"], False)
    return out


def scans(rows, window):
    """rows: [(pair, t, seq, port)] -> {seq: (distinct ports, attempts)} in the last `window`."""
    out = {}
    for pair, t, seq, port in rows:
        seen = [p for q, u, s, p in rows if q == pair and t - window <= u and (u, s) <= (t, seq)]
        out[seq] = (len(set(seen)), len(seen))
    return out
