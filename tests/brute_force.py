"""Plain sequential versions of the set-based operators, for small inputs."""

from collections import defaultdict


def fefo(demand, lots):
    """demand: (batch, day, material, qty); lots: (stock, material, expiry, qty). Returns takes, rejected."""
    left = {stock: qty for stock, _, _, qty in lots}
    shelves = defaultdict(list)
    for stock, material, expiry, _ in lots:
        shelves[material].append((expiry, stock))
    for shelf in shelves.values():
        shelf.sort()
    batches = defaultdict(list)
    for batch, day, material, qty in demand:
        if qty > 0:
            batches[(day, batch)].append((material, qty))
    takes, rejected = {}, set()
    for (day, batch) in sorted(batches):
        plan = []
        for material, qty in batches[(day, batch)]:
            open_lots = [s for e, s in shelves[material] if e >= day and left[s] > 0]
            if sum(left[s] for s in open_lots) < qty:
                plan = None
                break
            for stock in open_lots:
                if qty <= 0:
                    break
                take = min(qty, left[stock])
                plan.append((material, stock, take))
                qty -= take
        if plan is None:
            rejected.add(batch)
            continue
        for material, stock, take in plan:
            left[stock] -= take
            takes[(batch, material, stock)] = take
    return takes, rejected


def admit(needs, capacity):
    """needs: (request, resource, qty); capacity: resource -> qty. Returns rejected, in request order."""
    left = dict(capacity)
    by_request = defaultdict(list)
    for request, resource, qty in needs:
        by_request[request].append((resource, qty))
    rejected = set()
    for request in sorted(by_request):
        if any(left.get(resource, 0) < qty for resource, qty in by_request[request]):
            rejected.add(request)
            continue
        for resource, qty in by_request[request]:
            left[resource] -= qty
    return rejected
