"""Named queries. Each takes the filings and returns a lazy DataFrame.

Left without an entity, a query answers for all entities at once with the
entity as an extra column, and leaves the rows unsorted: a global sort of a
fact-sized result buys nothing. Asked for one entity, period or top-n, it
returns the few rows in order.
"""
