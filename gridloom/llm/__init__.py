"""Operations of a training-data pipeline over a documents table.

Nothing else in the library imports this subpackage. Every operator works on
any DataFrame that has the columns it names; the thin queries over the test
tables are in :mod:`gridloom.llm.queries`.
"""
