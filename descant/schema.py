"""Record types of the engine, as Spark DDL."""

from __future__ import annotations

WORD = "struct<word:string,start:double,end:double>"
HEARD = "struct<word:string,start:double,end:double,probability:double>"
LINE = f"line_id int, text string, words array<{WORD}>, start double, end double, source string"
LINE_FIELDS = "line_id text words start end source".split()
QUEUE_ITEM = "struct<user:string,file:string,title:string,semitones:int,paused:boolean>"
JOB = "struct<id:string,title:string,url:string,user:string,song_path:string,download_status:string,processing_status:string,processing_phase:string,error_message:string,cancelling:boolean,lyric_method:string>"

#: Columns of the catalogue with type and the value that rows of older versions read.
SONGS = [
    ("id", "bigint", None),
    ("file_path", "string", None),
    ("youtube_id", "string", None),
    ("format", "string", None),
    ("artist", "string", None),
    ("title", "string", None),
    ("variant", "string", None),
    ("year", "int", None),
    ("genre", "string", None),
    ("metadata_status", "string", "pending"),
    ("enrichment_attempts", "int", 0),
    ("last_enrichment_attempt", "timestamp", None),
    ("loudnorm_offset_db", "double", None),
    ("pipeline_state", "string", "skipped"),
    ("created_at", "timestamp", None),
    ("updated_at", "timestamp", None),
]
PIPELINE_STATES = ("pending", "ready", "failed", "skipped")
METADATA = "key string, value string"
CAPTION_RECORD = "id bigint, trackName string, artistName string, albumName string, duration double, syncedLyrics string"
