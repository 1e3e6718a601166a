"""Sources: turn raw inputs (text files, page tables, stored web pages, model lists) into
DataFrames of plain text."""
