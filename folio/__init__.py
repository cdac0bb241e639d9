"""folio: page-layout and document-text analytics for digitised books on PySpark."""
