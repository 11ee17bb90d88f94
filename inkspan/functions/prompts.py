"""Prompts for language-model extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = """You read invoices. From the text of one invoice, answer with one JSON object and nothing else:
{"header": {"invoice_no", "invoice_date", "seller", "client", "seller_tax_id", "client_tax_id", "iban"},
 "items": [{"item_desc", "item_qty", "item_net_price", "item_net_worth", "item_vat", "item_gross_worth"}],
 "summary": {"total_net_worth", "total_vat", "total_gross_worth"}}
Every value is a string written exactly as printed: keep dates, currency signs and decimal marks as they are, and never compute.
invoice_no, invoice_date, item_desc and total_net_worth must be there; a value that is not printed is null.
Example. Text: "Invoice no: 51 / Date of issue: 04/13/2013 / Items / 1. Oak table 2,00 each 40,00 80,00 10% 88,00 / Summary / Total $ 80,00 $ 8,00 $ 88,00"
Answer: {"header": {"invoice_no": "51", "invoice_date": "04/13/2013", "seller": null, "client": null, "seller_tax_id": null, "client_tax_id": null,
 "iban": null}, "items": [{"item_desc": "Oak table", "item_qty": "2,00", "item_net_price": "40,00", "item_net_worth": "80,00", "item_vat": "10%",
 "item_gross_worth": "88,00"}], "summary": {"total_net_worth": "$ 80,00", "total_vat": "$ 8,00", "total_gross_worth": "$ 88,00"}}"""


#: The line after which a request holds the document's text.
TEXT_MARK = "Text of the invoice:\n"


def system_prompt() -> Column:
    return F.lit(SYSTEM)


def user_prompt(file_name: Column, engine: Column, raw_text: Column) -> Column:
    """The request for one document."""
    return F.concat(F.lit("Read this invoice.\nFile: "), file_name, F.lit("\nRead by: "), engine, F.lit("\n"), F.lit(TEXT_MARK), raw_text)
