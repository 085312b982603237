"""Validation losses of the published 100-epoch run, in epoch order."""

VAL_LOSS = (
    3.554736003, 3.388332840, 3.352193285, 3.338064844, 3.331559501, 3.327771462,
    3.324749145, 3.323597701, 3.322140108, 3.321800965, 3.321193610, 3.320745462,
    3.320370174, 3.320204258, 3.319923355, 3.319719220, 3.319689761, 3.319522299,
    3.319354140, 3.319227339, 3.319172342, 3.319115135, 3.319069089, 3.319032507,
    3.319002063, 3.318973583, 3.318950340, 3.318939176, 3.318929143, 3.318918938,
    3.318908953, 3.318899954, 3.318890819, 3.318886149, 3.318881810, 3.318877182,
    3.318872517, 3.318868267, 3.318863521, 3.318861419, 3.318858739, 3.318855883,
    3.318853541, 3.318850904, 3.318848095, 3.318846552, 3.318845140, 3.318843986,
    3.318842116, 3.318840152, 3.318838628, 3.318836431, 3.318834626, 3.318832738,
    3.318831041, 3.318829354, 3.318828614, 3.318827488, 3.318826576, 3.318825725,
    3.318824496, 3.318823579, 3.318822958, 3.318822359, 3.318821854, 3.318821130,
    3.318820681, 3.318820106, 3.318819634, 3.318819237, 3.318818960, 3.318818512,
    3.318818068, 3.318817511, 3.318817100, 3.318816731, 3.318816353, 3.318815978,
    3.318815487, 3.318815142, 3.318814824, 3.318814380, 3.318814057, 3.318813711,
    3.318813407, 3.318813033, 3.318812842, 3.318812490, 3.318812243, 3.318811944,
    3.318811659, 3.318811411, 3.318811224, 3.318811000, 3.318810785, 3.318810527,
    3.318810373, 3.318810182, 3.318810004, 3.318809831,
)

# Epochs from which a halved learning rate is in force.
DROPS = (28, 34, 40, 46, 57, 63, 69)
