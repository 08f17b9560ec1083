"""Where spanned cells stand, counted in intervals so that spans of any size cost the same."""

#: Spans of more bits make a table unreadable; sums of spans stay far inside 64 bits.
SPAN_BITS = 47


def place(rows, limit=None):
    """First free column for every ``(rowspan, colspan)`` of every row.

    ``limit`` is a width past which nothing is held. Returns the columns, row by
    row, and whether any two cells overlap.
    """
    columns, overlaps, hanging = [], False, []
    for r, row in enumerate(rows):
        hanging = [h for h in hanging if h[2] >= r]
        taken, k, col, here = sorted(hanging), 0, 0, []
        for rowspan, colspan in row:
            while k < len(taken) and taken[k][0] <= col:
                col = max(col, taken[k][1])
                k += 1
            end, bottom = col + max(colspan, 1), r + max(rowspan, 1) - 1
            overlaps = overlaps or (k < len(taken) and taken[k][0] < end)
            if bottom > r and (limit is None or col < limit):
                hanging.append((col, end if limit is None else min(end, limit), bottom))
            here.append(col)
            col = end
        columns.append(here)
    return columns, overlaps


def shown(rows):
    """Where each cell first shows, column by column, if a later cell takes the slots it overlaps.

    (None, None) for a cell that shows nowhere within the first row's width: one without height or
    width, or one that others cover. Slots are counted in blocks between the places
    where some cell begins or ends, so a grid of n cells has 2n by 2n at most.
    """
    height, limit = len(rows), sum(w for _, w in rows[0])
    boxes, hanging = [], []
    for r, row in enumerate(rows):
        hanging = [h for h in hanging if h[2] >= r]
        col = 0
        for h, w in row:
            while col < limit:
                over = max((b for a, b, _ in hanging if a <= col < b), default=col)
                if over == col:
                    break
                col = over
            right, bottom = min(col + w, limit), min(r + h, height)
            boxes.append((r, bottom, col, right))
            if bottom > r and right > col:
                hanging.append((col, right, bottom - 1))
            col += w
    xs = sorted({x for _, _, a, b in boxes for x in (a, b)})
    column = {x: i for i, x in enumerate(xs)}
    owner = {}
    for n, (r, bottom, a, b) in enumerate(boxes):
        if bottom > r and b > a:
            for i in range(column[a], column[b]):
                for rr in range(r, bottom):
                    owner[i, rr] = n
    first = {}
    for i, r in sorted(owner):
        first.setdefault(owner[i, r], (r, xs[i]))
    numbers = iter(range(len(boxes)))
    return [[first.get(next(numbers), (None, None)) for _ in row] for row in rows]
