"""Golden inputs and results (fixed values)."""

P2OBS = [0.02, 0.15, 0.74, 3.39, 0.83, 22.37, 10.15, 15.43, 38.62, 15.92, 34.60, 10.28, 1.47, 0.40, 0.05, 11.39, 0.27, 0.42, 0.09, 11.37]
P2Q = [0.02, 0.493895, 4.44063, 17.2039, 38.62]
P2N = [1, 6, 10, 16, 20]
MPDATA = [132, 161, 144, 145, 31, 44, 47, 26, 232, 236, 254, 262, 339, 360, 313, 340, 1]
MP = [1.5010956572519172, 1.7133271671869412, 1.4465117438199946, 2.2386180615118265, 1.4207401525040495, 0.62038241908389491, 0.39903111714324457, 1.0783010406460811, 0.17635816443144478, 0.62038241908389491, 0.17635816443144478, 1.0783010406460811, 1.446511743819994]
MPI = [7, 4, 12, 1, 11, 9, 10, 11, 10, 5, 8, 7, 2]
PCC = [[1, 2, 5, 10], [0, 1, 2, 3], [-1, 0, 7, 26], [1, 2, 3, 4]]
