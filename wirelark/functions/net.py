"""Column expressions on packets and flow records. Everything here stays inside Catalyst."""

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.schemas import TCP_FLAG_NAMES

# UDP service-discovery and address-assignment ports left out by default.
DISCOVERY_PORTS = (1900, 5353, 5355, 137, 138, 27036, 67, 68)


def protocol_number(proto: Column) -> Column:
    """'TCP', '6' and the float rendering '6.0' all become '6', likewise for UDP; others stay."""
    name = F.upper(F.trim(proto))
    return (F.when(name.isin("UDP", "17", "17.0"), F.lit("17"))
             .when(name.isin("TCP", "6", "6.0"), F.lit("6"))
             .otherwise(proto))


def protocol_name(proto: Column) -> Column:
    number = protocol_number(proto)
    return (F.when(number == "6", F.lit("TCP"))
             .when(number == "17", F.lit("UDP"))
             .otherwise(F.concat(F.lit("Proto-"), proto)))


def is_broadcast_or_multicast(ip: Column) -> Column:
    """Limited or subnet broadcast, or a first octet in 224..239."""
    return F.coalesce(ip.rlike(r"\.255\z|^0*(22[4-9]|23[0-9])\."), F.lit(False))


def unicast_only(packets: DataFrame) -> DataFrame:
    return packets.where(~is_broadcast_or_multicast(F.col("src_ip"))
                         & ~is_broadcast_or_multicast(F.col("dst_ip")))


def parse_ports(text: str) -> list[int]:
    """Comma-separated ports of a setting; anything that is not a plain number is skipped."""
    return [int(part) for part in map(str.strip, text.split(",")) if part.isdigit()]


def parse_ports_column(text: Column) -> Column:
    """The same rule on a column: '53, x,67' -> [53, 67]."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def without_ports(packets: DataFrame, ports=DISCOVERY_PORTS) -> DataFrame:
    ports = list(ports)
    if not ports:
        return packets
    return packets.where(~F.col("src_port").isin(ports) & ~F.col("dst_port").isin(ports))


def tcp_udp_only(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("proto").isin("6", "17"))


def flags_from_letters(letters: Column) -> Column:
    """'SA' -> struct(FIN=false, SYN=true, ..., ACK=true, ...); a flag's letter is its initial."""
    return F.struct(*[letters.contains(name[0]).alias(name) for name in TCP_FLAG_NAMES])


def flags_from_bits(bits: Column) -> Column:
    """Low byte 13 of the TCP header; bit i of the byte is the i-th flag of TCP_FLAG_NAMES."""
    return F.struct(*[(bits.bitwiseAND(1 << i) != 0).alias(name)
                      for i, name in enumerate(TCP_FLAG_NAMES)])


def is_client_syn() -> Column:
    """A connection attempt: TCP with SYN and without ACK."""
    return F.coalesce((F.col("proto") == "6") & F.col("tcp_flags.SYN") & ~F.col("tcp_flags.ACK"), F.lit(False))


def flow_id(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column,
            proto: Column) -> Column:
    return F.concat_ws("-", src_ip, dst_ip, src_port.cast("string"), dst_port.cast("string"), proto)


def mitigation_rule(is_attack: Column, src_ip: Column) -> Column:
    """A suggested firewall rule as text; it is never executed."""
    return F.when(is_attack & (src_ip != "0.0.0.0"),
                  F.concat(F.lit("sudo iptables -A INPUT -s "), src_ip, F.lit(" -j DROP"))
            ).otherwise(F.lit("N/A"))


def with_direction_key(packets: DataFrame) -> DataFrame:
    """Adds `flow_key`, equal for both directions of a 5-tuple, and `side`, 0 when the source is
    the lower endpoint. A packet to itself has side 0 in both directions, so it is forward."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low = F.when(src <= dst, src).otherwise(dst)
    high = F.when(src <= dst, dst).otherwise(src)
    return (packets
            .withColumn("side", F.when(src <= dst, F.lit(0)).otherwise(F.lit(1)))
            .withColumn("flow_key", F.concat_ws(
                "|", low["ip"], low["port"].cast("string"),
                high["ip"], high["port"].cast("string"), F.col("proto"))))


def seconds_to_4_places(us: Column) -> Column:
    """Microseconds as seconds rounded half-even to four places, decided on whole numbers."""
    units, rest = F.floor(us / 100), F.pmod(us, F.lit(100))
    up = (rest > 50) | ((rest == 50) & (units % 2 != 0))
    return (units + up.cast("int")) / F.lit(10000.0)
