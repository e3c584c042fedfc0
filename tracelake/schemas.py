"""Schemas of the decoded records and of the event table."""


ITEM = "struct<item_type:smallint,item_type_size:smallint,offset:int,item_size:int,message_strings:string,item:string>"
ITEMS = f"array<{ITEM}>"

_EVENT = (
    "activity_type:int,log_type:int,flags:int,format_location:bigint,thread_id:bigint,delta:bigint,"
    f"items:{ITEMS},backtrace:array<string>,message_flags:array<string>,"
    "activity_id:bigint,activity_id_2:bigint,activity_id_3:bigint,unique_pid:bigint,private_offset:int,private_size:int,pc_id:bigint,subsystem_id:int,ttl:int,"
    "data_ref:bigint,signpost_id:bigint,signpost_name:bigint,loss_start:bigint,loss_end:bigint,loss_count:bigint,main_exe:boolean,shared_cache:boolean,absolute:boolean,"
    "uuid_relative:string,alt_index:int,large_offset:int,large_shared_cache:int"
)
_IMAGE, _SUBSYSTEM = "struct<uuid:string,size:bigint,load_address:bigint>", "struct<id:int,subsystem:string,category:string>"

#: One record of a trace file; the column named by kind is set, the others are null.
RECORD_KINDS = {
    "header": "struct<numerator:bigint,denominator:bigint,build:string,model:string,boot_uuid:string,logd_pid:bigint,timezone:string>",
    "catalog": f"struct<earliest:bigint,processes:array<struct<p1:bigint,p2:bigint,pid:bigint,euid:bigint,main_uuid:string,dsc_uuid:string,images:array<{_IMAGE}>,subsystems:array<{_SUBSYSTEM}>>>,spans:array<struct<start:bigint,end:bigint,size:bigint>>>",
    "firehose": f"struct<p1:bigint,p2:bigint,base_time:bigint,ttl:int,events:array<struct<{_EVENT}>>>",
    "oversize": f"struct<p1:bigint,p2:bigint,time:bigint,data_ref:bigint,items:{ITEMS}>",
    "statedump": "struct<p1:bigint,p2:bigint,time:bigint,activity_id:bigint,uuid:string,data_type:bigint,library:string,decoder:string,title:string,data:binary>",
    "simpledump": "struct<p1:bigint,p2:bigint,time:bigint,thread_id:bigint,sender_uuid:string,dsc_uuid:string,subsystem:string,message:string>",
}
#: ticks_from and ticks_to are the zone of the chunkset that holds a record, null where its catalog has none.
RECORD_DDL = "evidence string, catalog_seq int, chunk_seq int, kind string, ticks_from bigint, ticks_to bigint, " + ", ".join(f"{k} {v}" for k, v in RECORD_KINDS.items())
TIMESYNC_DDL = "path string, boot_seq int, boot_uuid string, numerator bigint, denominator bigint, boot_time bigint, seq int, kernel_time bigint, walltime bigint"
#: base: where the bytes of a range begin in its file's text.
UUIDTEXT_DDL = "uuid string, path string, image string, entries array<struct<start:bigint,size:bigint,base:bigint>>, footer binary"
DSC_DDL = "uuid string, path string, ranges array<struct<low:bigint,size:bigint,image:bigint,base:bigint>>, images array<struct<uuid:string,path:string>>, content binary"

#: The event table, in the order of its fields, then the lineage that gives the order of emission.
EVENT_COLUMNS = {
    "subsystem": "string", "thread_id": "bigint", "pid": "bigint", "euid": "bigint", "library": "string", "library_uuid": "string", "activity_id": "bigint",
    "parent_activity_id": "bigint", "time": "double", "category": "string", "event_type": "string", "log_type": "string", "process": "string", "process_uuid": "string",
    "message": "string", "raw_message": "string", "boot_uuid": "string", "timezone_name": "string", "message_entries": ITEMS, "timestamp": "string",
    "message_flags": "array<string>", "evidence": "string",
}
LINEAGE = ["catalog_seq", "section", "chunk_seq", "event_seq"]
