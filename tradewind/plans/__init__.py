"""Queries over the canonical inputs, by theme.

What holds unless a function says otherwise: aggregates skip nulls; a null key is a group of its
own, matches nothing in a join and stays on the left side of a left join; ratios with nought or
null below are null; ties are settled by the last column of an order, which is unique; repeated
rows count as often as they stand where no key says that they are the same; empty tables give
no rows, or one row of noughts where a query reports totals; other columns are ignored.
"""
