"""Column names and Spark schemas shared by the batch and the streaming operators."""

from pyspark.sql import types as T

TCP_FLAG_NAMES = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]

TCP_FLAGS = T.StructType([T.StructField(name, T.BooleanType()) for name in TCP_FLAG_NAMES])

PACKET = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("pkt_len", T.IntegerType()),
    T.StructField("header_len", T.IntegerType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("tcp_flags", TCP_FLAGS),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
])

# The flow statistics a trained model expects, by name and in this order.
FEATURE_NAMES = [
    "Src Port", "Dst Port", "Protocol", "Flow Duration",
    "Total Fwd Packet", "Total Bwd packets",
    "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Fwd Segment Size Avg", "Bwd Segment Size Avg",
    "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg", "Bwd Bulk Rate Avg",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

FLOW_FEATURES = T.StructType([
    T.StructField(name, T.StringType() if name == "Protocol" else T.DoubleType())
    for name in FEATURE_NAMES
])

# Columns of a labelled flow table that carry no signal.
IDENTIFIER_COLUMNS = ["Flow ID", "Src IP", "Dst IP", "Timestamp"]
CONSTANT_COLUMNS = [
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "URG Flag Count", "CWR Flag Count", "ECE Flag Count",
    "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg", "Fwd Bulk Rate Avg",
]

# Column order of the flat detection record.
DETECTION_CSV_COLUMNS = [
    "timestamp", "epoch", "event", "attack_type", "is_attack", "confidence",
    "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "interface",
    "duration_sec", "total_packets", "total_bytes", "fwd_packets", "bwd_packets",
    "fwd_bytes", "bwd_bytes", "packets_per_sec", "bytes_per_sec", "mitigation_rule",
]
