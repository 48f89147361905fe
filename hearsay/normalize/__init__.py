"""From raw payload tables to the normalized tables.

Inputs are tables with a text column ``body`` (JSON, or HTML where said) and the columns that
identify the request: an id, a keyword, a page number. Bodies are parsed once to a variant and
read by path, so drifting types give NULL instead of failed jobs.
"""
