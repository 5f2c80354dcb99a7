"""Constants of the distribution functions."""

#: Fixed values of West (2005), the rational form of the normal CDF, leading coefficient first.
WEST_N = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
WEST_D = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
