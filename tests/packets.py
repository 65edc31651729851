"""Small hand-made packets."""

from wirelark.schemas import PACKET, TCP_FLAG_NAMES


def packet(seq, t, src, dst, letters="", payload=0, proto="6", header=None, window=0):
    """`src` / `dst` are 'ip:port', `t` is in seconds."""
    (sip, sport), (dip, dport) = src.split(":"), dst.split(":")
    flags = {n: n[0] in letters for n in TCP_FLAG_NAMES} if proto == "6" else None
    header = header if header is not None else (20 if proto == "6" else 8)
    return (seq, sip, int(sport), dip, int(dport), proto, 20 + header + payload, header,
            round(t * 1e6), flags, window, payload)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKET)
