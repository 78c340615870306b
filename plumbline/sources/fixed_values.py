"""Names that dataset formats define."""

# Published word and class lists that readers must agree with.

#: English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
    shan shouldn wasn weren won wouldn
    """.split()
)

#: Classes of the 20 newsgroups, in the order of their labels.
NEWSGROUPS = tuple(
    """
    alt.atheism comp.graphics comp.os.ms-windows.misc comp.sys.ibm.pc.hardware comp.sys.mac.hardware comp.windows.x
    misc.forsale rec.autos rec.motorcycles rec.sport.baseball rec.sport.hockey sci.crypt sci.electronics sci.med sci.space
    soc.religion.christian talk.politics.guns talk.politics.mideast talk.politics.misc talk.religion.misc
    """.split()
)

#: Classes of Reuters-52, in the order of their labels.
REUTERS_52 = tuple(
    """
    acq alum bop carcass cocoa coffee copper cotton cpi cpu crude dlr earn fuel gas gnp gold grain heat housing income
    instal-debt interest ipi iron-steel jet jobs lead lei livestock lumber meal-feed money-fx money-supply nat-gas nickel
    orange pet-chem platinum potato reserves retail rubber ship strategic-metal sugar tea tin trade veg-oil wpi zinc
    """.split()
)

#: Corruptions of CIFAR-10-C and CIFAR-100-C.
CIFAR_C = tuple(
    """
    brightness contrast defocus_blur elastic_transform fog frost gaussian_blur gaussian_noise glass_blur impulse_noise
    jpeg_compression motion_blur pixelate saturate shot_noise snow spatter speckle_noise zoom_blur
    """.split()
)

#: Corruptions of MNIST-C.
MNIST_C = tuple(
    """
    brightness canny_edges dotted_line fog glass_blur identity impulse_noise motion_blur rotate scale shear shot_noise
    spatter stripe translate zigzag
    """.split()
)

#: Families of ImageNet-C.
IMAGENET_C = ("blur", "digital", "extra", "noise", "weather")

#: Speakers of the spoken-digit recordings with known metadata: (gender, accent, language).
FSDD_SPEAKERS = {
    "jackson": ("male", "USA/neutral", "english"),
    "nicolas": ("male", "BE/French", "english"),
    "theo": ("male", "USA/neutral", "english"),
}
