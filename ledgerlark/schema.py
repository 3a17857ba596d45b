"""Schemas of the engine's inputs and nested documents, as DDL."""

from __future__ import annotations

LAYOUT = "document string, total_pages int, outline array<struct<level:int,title:string,page:int>>, pages array<struct<page_number:int,width:double,height:double,lines:array<struct<text:string,size:double,bold:boolean,fonts:array<string>,bbox:array<double>>>>>"
PROVENANCE = "struct<document_id:string,page:int,source_text:string,bbox:array<double>>"
FACT = f"struct<value:string,unit:string,raw_value:string,provenance:array<{PROVENANCE}>>"
CATEGORY = f"struct<category_id:string,category_name:string,terms:map<string,{FACT}>>"
TERMS = [
    "tenor", "coupon_type", "frequency_of_interest_payment", "minimum_application", "face_value", "issue_price", "coupon", "effective_yield", "mode_of_interest_payment",
    "maturity_amount", "maturity_redemption", "nature_of_indebtedness", "put_call_option",
]
ISSUE_TERMS = ["issue_open_date", "issue_close_date", "allotment_date", "base_issue_size", "shelf_limit", "green_shoe_option", "security_type", "security_cover", "listing_exchange", "face_value"]
_terms = lambda names: "struct<" + ",".join(f"{n}:{FACT}" for n in names) + f",additional_terms:map<string,{FACT}>>"
SERIES = f"struct<series_id:string,series_name:string,terms:{_terms(TERMS)},categories:array<{CATEGORY}>,provenance:array<{PROVENANCE}>>"
RATING = f"struct<agency:string,rating:string,outlook:string,instrument:string,rating_date:string,provenance:array<{PROVENANCE}>>"
ISSUE = f"struct<issue_id:string,issue_name:string,terms:{_terms(ISSUE_TERMS)},debenture_trustee:string,lead_managers:array<string>,ratings:array<{RATING}>,series:array<{SERIES}>>"
CHUNK = f"struct<chunk_id:string,chunk_type:string,text:string,start_page:int,end_page:int,section_path:array<string>,series_id:string,category_id:string,provenance:array<{PROVENANCE}>>"
DOCUMENT = f"document struct<document_id:string,document_name:string,document_type:string,document_date:string,page_count:int>, issuer struct<issuer_id:string,name:string,issues:array<{ISSUE}>>, chunks array<{CHUNK}>"
CELLS = "document_id string, page int, table_idx int, row int, col int, text string, x0 double, top double, x1 double, bottom double"
