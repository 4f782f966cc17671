"""Fixed values.

Strings, sizes and limits that input tables already carry, or that results must equal. They are facts about the
data, kept here in one place; nothing in this module is computed.
"""

# Bytes per element, by checkpoint dtype name and by framework dtype name.
ITEM_SIZES = {
    "F64": 8,
    "F32": 4,
    "F16": 2,
    "BF16": 2,
    "I64": 8,
    "I32": 4,
    "I16": 2,
    "I8": 1,
    "U8": 1,
    "BOOL": 1,
    "F8_E4M3": 1,
    "F8_E5M2": 1,
    "float64": 8,
    "float32": 4,
    "float16": 2,
    "bfloat16": 2,
    "int64": 8,
    "int32": 4,
    "int16": 2,
    "int8": 1,
    "uint8": 1,
    "bool": 1,
}

# Separates a buffer's base id from its shard number.
SHARD_MARK = "__shard_"
# Name of shard i+1 of n inside a checkpoint folder.
SHARD_FILE_FORMAT = "model-%05d-of-%05d.safetensors"

# Annotations that may carry a shard number, most specific first.
RANK_ANNOTATIONS = ("wpi.io/shard-index", "batch.kubernetes.io/job-completion-index", "ray.io/rank")
# Device class and device names used in resource claims and inventories.
DEVICE_CLASS = "wpi-device-class"
DEVICE_NAME_PREFIX = "wpi-device-"

KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024
LONG_MAX = 9223372036854775807

# Allocation granule when the device does not report one.
DEFAULT_GRANULE = 2 * MIB
# Size staged when a request names none.
DEFAULT_STAGE_BYTES = 10 * GIB
# How long a receiver waits for READY.
READY_TIMEOUT_SECONDS = 300
# Seconds between two inventory publications of one node.
SNAPSHOT_SECONDS = 30
# Iterations left out of latency statistics, and of the plain mean.
WARMUP_ITERATIONS = 3
MEAN_WARMUP_ITERATIONS = 5
# Room added over the exact model size when a buffer is created.
BUFFER_HEADROOM = 1.05

# Binary quantity suffixes, as powers of 1024.
BINARY_SUFFIXES = {"Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5, "Ei": 6}
# Decimal quantity suffixes, as powers of 10.
DECIMAL_SUFFIXES = {"n": -9, "u": -6, "m": -3, "": 0, "k": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}
QUANTITY_FORMAT = "^([+-]?[0-9.]+)([eEinumkKMGTP]*[-+]?[0-9]*)$"

# Condition reasons and messages.
MSG_NUM_SHARDS = "numShards must be > 0"
MSG_EXCLUSIVE = "shardFiles and filePattern are mutually exclusive"
MSG_NO_SOURCE = "sharding requires either shardFiles, filePattern, or capacity to compute splits"
MSG_READY = "WeightBuffer has been created and is ready"
MSG_FOUND = "Referenced WeightBuffer was found"
MSG_NOT_FOUND = "Referenced WeightBuffer was not found"
MSG_NOT_DISCOVERED = "WeightBuffer sharding not yet discovered (totalShards=0)"
MSG_NO_RANK = (
    'shardIndex not specified and no rank annotation found on claim "%s"; '
    "set spec.shardIndex or add annotation wpi.io/shard-index"
)
MSG_BAD_FORMAT = "quantities must match the regular expression '" + QUANTITY_FORMAT + "'"
MSG_BAD_SUFFIX = "unable to parse quantity's suffix"
