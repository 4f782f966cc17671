"""Explicit schemas of input files; nothing is inferred."""

METADATA = "struct<name:string,namespace:string,uid:string,annotations:map<string,string>>"
CONDITIONS = "array<struct<type:string,status:string,reason:string,message:string,lastTransitionTime:timestamp>>"

WEIGHT_BUFFER = f"""struct<
  metadata:{METADATA},
  spec:struct<
    capacity:string, sourcePath:string, provider:string, layout:string, retentionPolicy:string,
    sharding:struct<
      strategy:string, numShards:int,
      shardFiles:array<struct<index:int,path:string,sizeBytes:bigint>>, filePattern:string>>,
  status:struct<
    conditions:{CONDITIONS}, totalShards:int,
    discoveredShards:array<struct<index:int,path:string,sizeBytes:bigint>>>>"""

WEIGHT_CLAIM = f"""struct<
  metadata:{METADATA},
  spec:struct<weightBufferName:string, shardIndex:int, propagationPolicy:string, targetLayout:string>,
  status:struct<conditions:{CONDITIONS}, assignedShardIndex:int>>"""

RESOURCE_CLAIM = f"""struct<
  metadata:{METADATA},
  spec:struct<devices:struct<requests:array<struct<name:string, exactly:struct<deviceClassName:string>>>>>,
  status:struct<allocation:struct<devices:struct<results:array<struct<device:string>>>>>>"""

POD = f"""struct<metadata:{METADATA}, spec:struct<nodeName:string>, status:struct<phase:string, podIP:string>>"""

KINDS = {
    "WeightBuffer": WEIGHT_BUFFER,
    "WeightClaim": WEIGHT_CLAIM,
    "ResourceClaim": RESOURCE_CLAIM,
    "Pod": POD,
}

UPDATE_INFO = (
    "names array<string>, dtype_names array<string>, shapes array<array<bigint>>, offsets array<bigint>, "
    "total_bytes bigint"
)

# The events table as a stream source.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
