"""Training-data operators: tokenising, packing, scoring, filtering and deduplicating documents.

Every operator takes a DataFrame of documents and the names of its id and text columns. Columns beside
these two are never read, so extra columns may bear any name; operators that filter return them untouched.
"""
