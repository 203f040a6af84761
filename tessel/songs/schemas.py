"""Types of songs, lead sheets and requests."""

NOTE = "struct<onset:int,duration:int,pitch:int,lyric:array<string>,melisma:boolean,line:int>"
CHORD = "struct<onset:int,duration:int,symbol:string>"
SECTION = "struct<label:string,start_bar:int,num_bars:int>"
SONG = (
    "song_id string, meter_num int, tempo_bpm int, key string, bar_beats array<int>, "
    f"sections array<{SECTION}>, notes array<{NOTE}>, chords array<{CHORD}>, language string, meta map<string,string>"
)
LEAD_SHEET = (
    "song_id string, global struct<meter:string,tempo_bpm:double,key:string,language:string,key_agreement:string>, "
    "beats array<struct<time_sec:double,is_downbeat:boolean>>, sections array<struct<label:string,start_sec:double>>, "
    "syllables array<struct<syllable_id:string,text:string,normalized_text:string,start_sec:double,end_sec:double,line_id:string>>, "
    "lines array<struct<line_id:string,text:string,normalized_text:string>>, "
    "melody_notes array<struct<note_id:string,onset_sec:double,offset_sec:double,onset_grid_time_sec:double,offset_grid_time_sec:double,pitch_midi:int>>, "
    "note_lyric_alignment struct<items:array<struct<note_id:string,lyric_unit_id:string,is_lyric_continuation:boolean>>>, "
    "recognized_chords array<struct<symbol:string,root:string,quality:string,bass:string,start_sec:double>>"
)
TICKS_PER_BEAT = 4
