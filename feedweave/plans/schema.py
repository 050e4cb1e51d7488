"""The schema of parsed documents, in DDL."""

from __future__ import annotations

TEXT = "struct<value:string,content_type:string,language:string,base:string>"
LINK = "struct<href:string,rel:string,link_type:string,title:string,length:string,hreflang:string,thr_count:bigint,thr_updated:timestamp>"
PERSON = "struct<name:string,email:string,uri:string,avatar:string>"
TAG = "struct<term:string,scheme:string,label:string>"
CONTENT = "struct<value:string,content_type:string,language:string,base:string,src:string>"
GENERATOR = "struct<name:string,href:string,version:string>"
IMAGE = "struct<url:string,title:string,link:string,width:bigint,height:bigint,description:string>"
TEXTINPUT = "struct<title:string,description:string,name:string,link:string>"
CLOUD = "struct<domain:string,port:string,path:string,register_procedure:string,protocol:string>"
ENCLOSURE = "struct<url:string,length:string,enclosure_type:string,title:string,duration:string>"
SOURCE = f"struct<title:string,href:string,link:string,author:string,id:string,links:array<{LINK}>,updated:timestamp,updated_str:string,rights:string,guidislink:boolean>"
THUMBNAIL = "struct<url:string,width:string,height:string,time:string>"
MEDIA = "struct<url:string,content_type:string,medium:string,filesize:string,width:string,height:string,duration:string,bitrate:string,lang:string,channels:string,codec:string,expression:string,isdefault:string,samplingrate:string,framerate:string>"
RATING = "struct<scheme:string,content:string>"
CREDIT = "struct<role:string,scheme:string,content:string>"
COPYRIGHT = "struct<url:string>"
REPLY = "struct<ref:string,href:string,type:string,source:string>"
ITUNES_CATEGORY = "struct<text:string,subcategory:string>"
ITUNES_FEED = f"struct<author:string,owner:struct<name:string,email:string>,categories:array<{ITUNES_CATEGORY}>,explicit:boolean,image:string,keywords:array<string>,podcast_type:string,complete:string,new_feed_url:string,subtitle:string,summary:string,block:smallint>"
ITUNES_ENTRY = "struct<title:string,author:string,duration:string,explicit:boolean,image:string,episode:string,season:string,episode_type:string,subtitle:string,summary:string>"
GEO = "struct<geo_type:string,coordinates:array<struct<lat:double,lon:double>>,srs_name:string,elev:double,feature_type_tag:string,feature_name:string,relationship_tag:string>"
SYNDICATION = "struct<update_period:string,update_frequency:string,update_base:string>"
REMOTE_ITEM = "struct<feed_guid:string,feed_url:string,item_guid:string,medium:string,title:string>"
RECIPIENT = "struct<name:string,type:string,address:string,split:bigint,fee:boolean>"
TIME_SPLIT = f"struct<start_time:double,duration:double,remote_start_time:double,remote_percentage:double,recipients:array<{RECIPIENT}>,remote_item:{REMOTE_ITEM}>"
VALUE = f"struct<type:string,method:string,suggested:string,recipients:array<{RECIPIENT}>,time_splits:array<{TIME_SPLIT}>>"
PODCAST_PERSON = "struct<name:string,role:string,group:string,img:string,href:string>"
TRANSCRIPT = "struct<url:string,type:string,language:string,rel:string>"
FUNDING = "struct<url:string,message:string>"
LOCATION = "struct<name:string,geo:string,osm:string,rel:string,country:string>"
TXT = "struct<purpose:string,value:string>"
FOLLOW = "struct<url:string>"
CHAT = "struct<server:string,protocol:string,account_id:string,space:string>"
UPDATE_FREQUENCY = "struct<complete:boolean,dtstart:string,rrule:string,label:string>"
CHAPTERS = "struct<url:string,type:string>"
SOUNDBITE = "struct<start_time:double,duration:double,title:string>"
ALTERNATE = "struct<type:string,length:decimal(20,0),bitrate:double,height:bigint,lang:string,title:string,rel:string,codecs:string,is_default:boolean,sources:array<struct<uri:string,content_type:string>>,integrity:struct<type:string,value:string>>"
SOCIAL = "struct<uri:string,protocol:string,account_id:string,account_url:string,priority:bigint>"
PODCAST_FEED = f"struct<transcripts:array<{TRANSCRIPT}>,funding:array<{FUNDING}>,persons:array<{PODCAST_PERSON}>,guid:string,value:{VALUE},medium:string,locked:boolean,locked_owner:string,location:{LOCATION},podroll:array<{REMOTE_ITEM}>,txt:array<{TXT}>,update_frequency:{UPDATE_FREQUENCY},follow:array<{FOLLOW}>,chat:array<{CHAT}>,podping_uses_podping:boolean>"
PODCAST_ENTRY = f"struct<transcript:array<{TRANSCRIPT}>,chapters:{CHAPTERS},soundbite:array<{SOUNDBITE}>,persons:array<{PODCAST_PERSON}>,medium:string,season:string,episode:string,alternate_enclosures:array<{ALTERNATE}>,value:{VALUE},location:{LOCATION},social_interact:array<{SOCIAL}>,txt:array<{TXT}>,follow:array<{FOLLOW}>,chat:array<{CHAT}>>"

FEED = {
    "title": "string", "title_detail": TEXT, "link": "string", "links": f"array<{LINK}>", "subtitle": "string", "subtitle_detail": TEXT, "summary": "string", "summary_detail": TEXT,
    "updated": "timestamp", "updated_str": "string", "published": "timestamp", "published_str": "string", "author": "string", "author_detail": PERSON, "authors": f"array<{PERSON}>",
    "contributors": f"array<{PERSON}>", "publisher": "string", "publisher_detail": PERSON, "language": "string", "rights": "string", "rights_detail": TEXT, "generator": "string",
    "generator_detail": GENERATOR, "image": IMAGE, "icon": "string", "logo": "string", "tags": f"array<{TAG}>", "id": "string", "ttl": "string", "docs": "string", "itunes": ITUNES_FEED,
    "podcast": PODCAST_FEED, "dc_creator": "string", "dc_publisher": "string", "dc_rights": "string", "license": "string", "syndication": SYNDICATION, "where": GEO, "geo_lat": "double",
    "geo_long": "double", "next_url": "string", "media_thumbnail": f"array<{THUMBNAIL}>", "media_content": f"array<{MEDIA}>", "media_rating": RATING, "media_keywords": "string",
    "cloud": CLOUD, "textinput": TEXTINPUT, "skiphours": "array<int>", "skipdays": "array<string>", "json_extensions": "map<string,string>",
}
ENTRY = {
    "id": "string", "title": "string", "title_detail": TEXT, "link": "string", "links": f"array<{LINK}>", "subtitle": "string", "subtitle_detail": TEXT, "rights": "string",
    "rights_detail": TEXT, "summary": "string", "summary_detail": TEXT, "content": f"array<{CONTENT}>", "published": "timestamp", "published_str": "string", "updated": "timestamp",
    "updated_str": "string", "created": "timestamp", "created_str": "string", "expired": "timestamp", "author": "string", "author_detail": PERSON, "authors": f"array<{PERSON}>",
    "contributors": f"array<{PERSON}>", "publisher": "string", "publisher_detail": PERSON, "tags": f"array<{TAG}>", "enclosures": f"array<{ENCLOSURE}>", "comments": "string",
    "source": SOURCE, "itunes": ITUNES_ENTRY, "dc_creator": "string", "dc_date": "timestamp", "dc_subject": "array<string>", "dc_rights": "string", "media_thumbnail": f"array<{THUMBNAIL}>",
    "media_content": f"array<{MEDIA}>", "media_credit": f"array<{CREDIT}>", "media_copyright": COPYRIGHT, "media_rating": RATING, "media_keywords": "string", "media_description": "string",
    "media_title": "string", "podcast_transcripts": f"array<{TRANSCRIPT}>", "podcast_persons": f"array<{PODCAST_PERSON}>", "podcast": PODCAST_ENTRY, "where": GEO, "geo_lat": "double",
    "geo_long": "double", "license": "string", "in_reply_to": f"array<{REPLY}>", "thr_total": "bigint", "slash_comments": "bigint", "slash_hit_parade": "string",
    "wfw_comment_rss": "string", "guidislink": "boolean", "language": "string", "external_url": "string", "json_extensions": "map<string,string>",
}


def struct_ddl(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">"
