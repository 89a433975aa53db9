"""Column names, feature sets and label spellings of network-flow exports."""

# --- Fixed values: raw header spelling -> canonical name, in header order ---
COLUMN_MAP = {
    "flow id": "flow_id",
    "source ip": "src_ip",
    "source port": "src_port",
    "destination ip": "dst_ip",
    "destination port": "dst_port",
    "dst port": "dst_port",
    "protocol": "protocol",
    "timestamp": "timestamp",
    "label": "label",
    "flow duration": "flow_duration",
    "flow iat mean": "flow_iat_mean",
    "flow iat std": "flow_iat_std",
    "flow iat max": "flow_iat_max",
    "flow iat min": "flow_iat_min",
    "fwd iat total": "fwd_iat_tot",
    "fwd iat tot": "fwd_iat_tot",
    "fwd iat mean": "fwd_iat_mean",
    "fwd iat std": "fwd_iat_std",
    "fwd iat max": "fwd_iat_max",
    "fwd iat min": "fwd_iat_min",
    "bwd iat total": "bwd_iat_tot",
    "bwd iat tot": "bwd_iat_tot",
    "bwd iat mean": "bwd_iat_mean",
    "bwd iat std": "bwd_iat_std",
    "bwd iat max": "bwd_iat_max",
    "bwd iat min": "bwd_iat_min",
    "total fwd packets": "tot_fwd_pkts",
    "tot fwd pkts": "tot_fwd_pkts",
    "total backward packets": "tot_bwd_pkts",
    "tot bwd pkts": "tot_bwd_pkts",
    "total length of fwd packets": "totlen_fwd_pkts",
    "totlen fwd pkts": "totlen_fwd_pkts",
    "total length of bwd packets": "totlen_bwd_pkts",
    "totlen bwd pkts": "totlen_bwd_pkts",
    "fwd packet length max": "fwd_pkt_len_max",
    "fwd pkt len max": "fwd_pkt_len_max",
    "fwd packet length min": "fwd_pkt_len_min",
    "fwd pkt len min": "fwd_pkt_len_min",
    "fwd packet length mean": "fwd_pkt_len_mean",
    "fwd pkt len mean": "fwd_pkt_len_mean",
    "fwd packet length std": "fwd_pkt_len_std",
    "fwd pkt len std": "fwd_pkt_len_std",
    "bwd packet length max": "bwd_pkt_len_max",
    "bwd pkt len max": "bwd_pkt_len_max",
    "bwd packet length min": "bwd_pkt_len_min",
    "bwd pkt len min": "bwd_pkt_len_min",
    "bwd packet length mean": "bwd_pkt_len_mean",
    "bwd pkt len mean": "bwd_pkt_len_mean",
    "bwd packet length std": "bwd_pkt_len_std",
    "bwd pkt len std": "bwd_pkt_len_std",
    "min packet length": "pkt_len_min",
    "pkt len min": "pkt_len_min",
    "max packet length": "pkt_len_max",
    "pkt len max": "pkt_len_max",
    "packet length mean": "pkt_len_mean",
    "pkt len mean": "pkt_len_mean",
    "packet length std": "pkt_len_std",
    "pkt len std": "pkt_len_std",
    "packet length variance": "pkt_len_var",
    "pkt len var": "pkt_len_var",
    "flow bytes/s": "flow_byts_s",
    "flow byts/s": "flow_byts_s",
    "flow packets/s": "flow_pkts_s",
    "flow pkts/s": "flow_pkts_s",
    "fwd packets/s": "fwd_pkts_s",
    "fwd pkts/s": "fwd_pkts_s",
    "bwd packets/s": "bwd_pkts_s",
    "bwd pkts/s": "bwd_pkts_s",
    "fwd psh flags": "fwd_psh_flags",
    "bwd psh flags": "bwd_psh_flags",
    "fwd urg flags": "fwd_urg_flags",
    "bwd urg flags": "bwd_urg_flags",
    "fin flag count": "fin_flag_cnt",
    "fin flag cnt": "fin_flag_cnt",
    "syn flag count": "syn_flag_cnt",
    "syn flag cnt": "syn_flag_cnt",
    "rst flag count": "rst_flag_cnt",
    "rst flag cnt": "rst_flag_cnt",
    "psh flag count": "psh_flag_cnt",
    "psh flag cnt": "psh_flag_cnt",
    "ack flag count": "ack_flag_cnt",
    "ack flag cnt": "ack_flag_cnt",
    "urg flag count": "urg_flag_cnt",
    "urg flag cnt": "urg_flag_cnt",
    "cwe flag count": "cwe_flag_cnt",
    "ece flag count": "ece_flag_cnt",
    "ece flag cnt": "ece_flag_cnt",
    "fwd header length": "fwd_header_len",
    "fwd header len": "fwd_header_len",
    "bwd header length": "bwd_header_len",
    "bwd header len": "bwd_header_len",
    "down/up ratio": "down_up_ratio",
    "average packet size": "pkt_size_avg",
    "pkt size avg": "pkt_size_avg",
    "avg fwd segment size": "fwd_seg_size_avg",
    "fwd seg size avg": "fwd_seg_size_avg",
    "avg bwd segment size": "bwd_seg_size_avg",
    "bwd seg size avg": "bwd_seg_size_avg",
    "min_seg_size_forward": "fwd_seg_size_min",
    "fwd seg size min": "fwd_seg_size_min",
    "fwd avg bytes/bulk": "fwd_byts_b_avg",
    "fwd byts/b avg": "fwd_byts_b_avg",
    "fwd avg packets/bulk": "fwd_pkts_b_avg",
    "fwd pkts/b avg": "fwd_pkts_b_avg",
    "fwd avg bulk rate": "fwd_blk_rate_avg",
    "fwd blk rate avg": "fwd_blk_rate_avg",
    "bwd avg bytes/bulk": "bwd_byts_b_avg",
    "bwd byts/b avg": "bwd_byts_b_avg",
    "bwd avg packets/bulk": "bwd_pkts_b_avg",
    "bwd pkts/b avg": "bwd_pkts_b_avg",
    "bwd avg bulk rate": "bwd_blk_rate_avg",
    "bwd blk rate avg": "bwd_blk_rate_avg",
    "subflow fwd packets": "subflow_fwd_pkts",
    "subflow fwd pkts": "subflow_fwd_pkts",
    "subflow fwd bytes": "subflow_fwd_byts",
    "subflow fwd byts": "subflow_fwd_byts",
    "subflow bwd packets": "subflow_bwd_pkts",
    "subflow bwd pkts": "subflow_bwd_pkts",
    "subflow bwd bytes": "subflow_bwd_byts",
    "subflow bwd byts": "subflow_bwd_byts",
    "init_win_bytes_forward": "init_fwd_win_byts",
    "init fwd win byts": "init_fwd_win_byts",
    "init_win_bytes_backward": "init_bwd_win_byts",
    "init bwd win byts": "init_bwd_win_byts",
    "act_data_pkt_fwd": "fwd_act_data_pkts",
    "fwd act data pkts": "fwd_act_data_pkts",
    "active mean": "active_mean",
    "active std": "active_std",
    "active max": "active_max",
    "active min": "active_min",
    "idle mean": "idle_mean",
    "idle std": "idle_std",
    "idle max": "idle_max",
    "idle min": "idle_min",
}

# --- Fixed values: the 58 features by family, in fitted order ---
TIME_FEATURES = [
    "flow_duration", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_tot",
    "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min", "bwd_iat_tot", "bwd_iat_mean", "bwd_iat_std",
    "bwd_iat_max", "bwd_iat_min",
]
PACKET_FEATURES = [
    "tot_fwd_pkts", "tot_bwd_pkts", "flow_byts_s", "flow_pkts_s", "fwd_pkts_s", "bwd_pkts_s",
    "subflow_fwd_pkts", "subflow_fwd_byts", "subflow_bwd_pkts", "subflow_bwd_byts", "init_fwd_win_byts",
    "init_bwd_win_byts", "fwd_act_data_pkts",
]
LENGTH_FEATURES = [
    "totlen_fwd_pkts", "totlen_bwd_pkts", "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean",
    "fwd_pkt_len_std", "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
    "fwd_header_len", "bwd_header_len", "pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std",
    "pkt_len_var", "pkt_size_avg", "fwd_seg_size_avg", "bwd_seg_size_avg", "fwd_seg_size_min",
]
PROTOCOL_FEATURES = [
    "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt", "urg_flag_cnt",
    "ece_flag_cnt", "down_up_ratio", "fwd_psh_flags",
]
FEATURES = TIME_FEATURES + PACKET_FEATURES + LENGTH_FEATURES + PROTOCOL_FEATURES

# --- Fixed values: features that are counts or flags; all others are continuous ---
DISCRETE_FEATURES = [
    "tot_fwd_pkts", "tot_bwd_pkts", "subflow_fwd_pkts", "subflow_fwd_byts", "subflow_bwd_pkts",
    "subflow_bwd_byts", "init_fwd_win_byts", "init_bwd_win_byts", "fwd_act_data_pkts", "totlen_fwd_pkts",
    "totlen_bwd_pkts", "fwd_pkt_len_max", "fwd_pkt_len_min", "bwd_pkt_len_max", "bwd_pkt_len_min",
    "fwd_header_len", "bwd_header_len", "pkt_len_min", "pkt_len_max", "fwd_seg_size_min", "fin_flag_cnt",
    "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt", "urg_flag_cnt", "ece_flag_cnt",
    "fwd_psh_flags",
]
CONTINUOUS_FEATURES = [name for name in FEATURES if name not in DISCRETE_FEATURES]

# --- Fixed values: the underscore-named variant of the discrete features ---
UNDERSCORED_DISCRETE_FEATURES = [
    "fwd_header_length", "bwd_header_length", "fin_flag_count", "syn_flag_count", "psh_flag_count",
    "ack_flag_count", "urg_flag_count", "ece_flag_count", "subflow_fwd_bytes", "subflow_bwd_bytes",
    "fwd_init_win_bytes", "bwd_init_win_bytes", "fwd_act_data_pkts", "fwd_seg_size_min",
]

# --- Fixed values: the underscore-named variant of the continuous features ---
UNDERSCORED_CONTINUOUS_FEATURES = [
    "fwd_packet_length_max", "fwd_packet_length_min", "fwd_packet_length_std", "bwd_packet_length_min",
    "bwd_packet_length_std", "flow_bytes/s", "flow_packets/s", "flow_iat_mean", "flow_iat_std", "flow_iat_min",
    "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_min", "bwd_iat_total", "bwd_iat_mean",
    "bwd_iat_std", "bwd_iat_max", "bwd_iat_min", "fwd_packets/s", "bwd_packets/s", "packet_length_min",
    "packet_length_std", "packet_length_variance", "down/up_ratio", "average_packet_size",
    "fwd_segment_size_avg", "bwd_segment_size_avg", "active_mean", "active_std", "active_max", "active_min",
    "idle_std", "idle_max", "idle_min",
]

# --- Fixed values: label spellings ---
LABEL = "label"
NORMAL = "normal"
MAJORITY = "BENIGN"
LABEL_ALIASES = {
    "FTP-BRUTEFORCE": "FTP-PATATOR",
    "SSH-BRUTEFORCE": "SSH-PATATOR",
}

# --- Fixed values: attack named by the first part of a per-attack file name ---
ATTACK_BY_SOURCE = {
    "hydra": "hydra",
    "nikto": "nikto",
    "nmap": "nmap",
    "sqlmap": "sqli",
    "xss": "xss",
}

# Header spellings of columns that hold text.
TEXT_COLUMNS = {"flow id", "source ip", "src ip", "destination ip", "dst ip", "timestamp", "label"}


def feature_kinds(columns):
    """(discrete, continuous): the known features of a table in its order, whether its
    names went through the synonym map or only got underscores."""
    discrete = {*DISCRETE_FEATURES, *UNDERSCORED_DISCRETE_FEATURES}
    continuous = {*CONTINUOUS_FEATURES, *UNDERSCORED_CONTINUOUS_FEATURES} - discrete
    return [c for c in columns if c in discrete], [c for c in columns if c in continuous]


def feature_table(spark):
    """Name, kind and family of every feature as a table."""
    from flowgauge.functions.small import local_table

    families = {"time": TIME_FEATURES, "packet": PACKET_FEATURES,
                "length": LENGTH_FEATURES, "protocol": PROTOCOL_FEATURES}
    rows = [(name, "discrete" if name in DISCRETE_FEATURES else "continuous", family)
            for family, names in families.items() for name in names]
    name, kind, family = map(list, zip(*rows))
    return local_table(spark, {"name": name, "kind": kind, "family": family},
                       "name string, kind string, family string")
