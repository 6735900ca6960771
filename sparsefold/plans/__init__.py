"""The registered queries of the library and the SQL that each is held against."""
