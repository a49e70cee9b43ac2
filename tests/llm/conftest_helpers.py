"""Plain forms that tests compare with."""


def ffd(lengths, capacity):
    """First-fit decreasing by looking at every open sequence."""
    room, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b, left in enumerate(room):
            if left >= lengths[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return out
