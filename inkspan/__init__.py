"""A PySpark-native document-analytics engine for invoices and receipts."""
