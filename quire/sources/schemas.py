"""Schemas of recognised documents. Of the keys that tables may have besides, those that name them are read."""

TABLE = "struct<id:string,html:string,markdown:string,content:string,table_id:string,file_name:string,path:string,placeholder:string>"
IMAGE = "struct<id:string,image_base64:string,extra:map<string,string>>"
PAGE = f"struct<index:bigint,markdown:string,images:array<{IMAGE}>,tables:array<{TABLE}>,header:string,footer:string>"
PAYLOAD = f"struct<model:string,pages:array<{PAGE}>>"
METADATA = "struct<title:string,author:string,language:string,publisher:string,description:string,subjects:array<string>>"
